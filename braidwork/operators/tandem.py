"""Tandem scan: at which period a sequence repeats itself, and how much of it.

A window of max(2 * period, floor) letters repeats if at least the share of its letters equal those a period on. Covered are the
equal letters inside such windows, and what they are equal to. Each sequence is one pass a period over a numpy vector, in Arrow
batches (as rows, every letter would be shuffled and sorted once a period); the choice among periods is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list


def covered(seq: str, max_period: int = 200, floor: int = 40, share: tuple[int, int] = (4, 5)) -> list[tuple[int, int]]:
    """(period, covered letters), of periods up to a third of seq that cover any."""
    import numpy as np

    s = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    found = []
    for p in range(1, min(max_period, len(s) // 3) + 1):
        w = max(2 * p, floor)
        if w + p > len(s):
            break
        equal = s[:-p] == s[p:]
        sums = np.r_[0, np.cumsum(equal)]
        good = share[1] * (sums[w:] - sums[:-w]) >= share[0] * w
        # a letter is inside a window if one of the w starts up to it is good
        starts = np.r_[0, np.cumsum(good)]
        j = np.arange(len(equal))
        inside = starts[np.minimum(j + 1, len(good))] > starts[np.maximum(j - w + 1, 0).clip(max=len(good))]
        hit = np.zeros(len(s), bool)
        hit[:-p] = equal & inside
        hit[p:] |= equal & inside
        if hit.any():
            found.append((p, int(hit.sum())))
    return found


def period_coverage(df: DataFrame, key: Names, seq: str, max_period: int = 200, floor: int = 40, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(key, letters, period, covered): a row for each period that covers any letters of a row's sequence; whole sequences, case kept.

    Null, empty and short sequences have no rows; repeated rows give theirs each. Rows are dealt over
    spark.sql.shuffle.partitions tasks, since they cost more than their bytes tell adaptive execution.
    """
    keys = _list(key)
    given = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{seq}`").cast("string").alias("seq_")).where("seq_ IS NOT NULL")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "seq_")
    given = given.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("seq_").to_pylist()
            found = [covered(s, max_period, floor, share) for s in texts]
            row = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            made = [pa.array([len(texts[k]) for k, f in enumerate(found) for _ in f], pa.int64()), *[pa.array([x[c] for f in found for x in f], pa.int64()) for c in range(2)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(row) for k in keys], *made], names=[*keys, "letters", "period", "covered"])

    return given.mapInArrow(run, f"{names}, letters long, period long, covered long")


def best_periods(coverage: DataFrame, key: Names, long_from: int = 7, least: tuple[int, int] = (85, 100)) -> DataFrame:
    """(key, kind, period, letters, covered, share): the period of each kind, short or long (from long_from), that covers most.

    Ties go to the smaller period. A period gives way to its smallest divisor of its kind that covers at least its share of
    it, so multiples do not win. One row of coverage for each key and period; keys and kinds without any have no row.
    """
    keys = _list(key)
    kind = F.when(F.col("period") >= long_from, "long").otherwise("short")
    c = coverage.withColumn("kind", kind)
    c = c.groupBy(*keys, "kind").agg(F.first("letters").alias("letters"), F.max_by("period", F.struct("covered", -F.col("period"))).alias("top"), F.max("covered").alias("best"), F.collect_list(F.struct("period", "covered")).alias("all"))
    stays = F.sort_array(F.filter("all", lambda x: (F.col("top") % x["period"] == 0) & (x["covered"] * least[1] >= F.col("best") * least[0])))
    c = c.withColumn("p", F.get(stays, F.lit(0)))  # max_period of them at most
    return c.select(*keys, "kind", F.col("p.period").alias("period"), "letters", F.col("p.covered").alias("covered"), F.round(F.col("p.covered") / F.col("letters"), 4).alias("share"))
