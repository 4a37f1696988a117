"""Fill-in-middle: the contract computed plainly, exact restoring, edge cases."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.llm import fim


def plainly(key, text):
    """The form and the output, by splitting."""
    lines = text.split("\n")
    units = [x + "\n" for x in lines[:-1]] + [lines[-1]] * (lines[-1] != "")
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", "\n", "a", "a\n", "a\nb", "\n\na\n\n", "x<P>y\nz", "a\r\nb\x0bc d\n", "é\n漢字🙂\n<\n", "<S\n>\n" * 3, "line\n" * 50_000, "w" * 300_000]


def test_transform_is_the_contract_and_restores():
    for text in TEXTS:
        for key in range(40):
            got = fim.transform(text, key)
            assert tuple(got) == plainly(key, text)
            assert fim.restore(got.output, got.form) == text
    forms = {fim.transform("a\nb\nc", k).form for k in range(40)}
    assert forms == {"psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM>\n aé"), st.integers())
def test_any_text_restores(text, key):
    got = fim.transform(text, key)
    assert fim.restore(got.output, got.form) == text and tuple(got) == plainly(key, text)


def test_rates_units_and_wrong_forms():
    rule = fim.Rule(unit=r"(?s).", percent=30, spm_percent=0, markers=fim.Markers("[p]", "[s]", "[m]"))
    forms = [fim.transform("some text", k, rule) for k in range(2000)]
    assert 500 < sum(x.form == "psm" for x in forms) < 700 and all(x.form in ("psm", "plain") for x in forms)
    assert all(fim.restore(x.output, x.form, rule.markers) == "some text" for x in forms)
    with pytest.raises(ValueError):
        fim.transform("a b", 1, fim.Rule(unit=r"\w"))
    with pytest.raises(ValueError):
        fim.restore("<P>a", "spm")


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb"), (None, None), (3, "a\n"), (3, "a\n"), (-5, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "`doc id` long, text string").withColumn("output", F.lit("clash")).withColumn("made_", F.lit("clash"))
    got = fim.fill_in_middle(docs, key="doc id").collect()
    want = []
    for key, text in rows:
        made = plainly("" if key is None else key, text or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((key, *made[:4], sha(made[4]), sha(text or ""), made[4]))
    by = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=by) == sorted(want, key=by)
    assert fim.fill_in_middle(docs.limit(0), key="doc id", with_output=False).collect() == []
