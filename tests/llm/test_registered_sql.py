"""The new operators' queries on the smallest tables: against their SQL, or against the library that defines the result."""

import hashlib

import duckdb
import numpy as np
import pytest

from braidwork.llm import collocations, fim, prefix_bpe, registry

D = "/root/testdata/sf0.001"


def test_op12_and_op13_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    for name, sql in (("op12_phrase_collocations", collocations.OP12_SQL), ("op13_fill_in_middle", fim.OP13_SQL)):
        got = registry.QUERIES[name](spark, D)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_op11_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    ranks = prefix_bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).vocabulary.ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = registry.QUERIES["op11_prefix_bpe"](spark, D).collect()
    want = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {k: (len(v), sha(np.array(v, "<u4").tobytes()), sha(texts[k].encode())) for k, v in want.items()}
