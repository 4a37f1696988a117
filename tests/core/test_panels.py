"""Rules of panel operators on small tables: what is missing, ties, nulls, empty tables, each kind of conflict."""

import pytest
from pyspark.sql import functions as F

from braidwork.operators import haplotypes as H
from braidwork.operators import panels as P


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_looked_up_ends_with_an_error_where_a_name_is_missing(spark):
    names = table(spark, [(1, "a"), (2, None)], "k int, v string")
    assert found(P.looked_up(table(spark, [(1,), (2,)], "k int"), names, "k", "v")) == [(1, "a"), (2, None)]
    for bad in (3, None):
        with pytest.raises(Exception, match="no v for k"):
            P.looked_up(table(spark, [(bad,)], "k int"), names, "k", "v").collect()


def test_nested(spark):
    records = table(spark, [(1, 10, 20), (2, 12, 14), (3, 12, 14), (4, 10, 14)], "id int, left int, right int")
    inside = table(spark, [(1, 12), (1, 13), (1, 14), (2, 12), (3, 12), (3, 14), (3, 14)], "id int, node int")
    assert found(P.nested(records, inside)) == [(2, 1), (3, 1)]  # 2 lies in 3, but of one boundary
    assert found(P.nested(records, inside.limit(0))) == []


def test_orders_and_seeds(spark):
    df = table(spark, [("g", i, w, n) for i, w, n in ((1, 5.0, 3), (2, 5.0, 3), (3, 1.0, 1), (4, 1.0, 1), (5, 0.5, 2))], "g string, id int, w double, n int")
    place = lambda order: [i for _, i in sorted((r.place, r.id) for r in P.ordered(df, "g", order, "n", "id").collect())]
    assert (place("given"), place("longest"), place("shortest")) == ([1, 2, 3, 4, 5], [1, 2, 5, 3, 4], [3, 4, 5, 1, 2])
    assert sorted(place("random:1")) == [1, 2, 3, 4, 5] and place("random:1") == place("random:1")
    with pytest.raises(ValueError):
        P.input_order("widest", "n", "id")
    assert {r.id for r in P.seeds(df, "g", "id", "w", "n", 1).where("seed").collect()} == {1, 4}


def test_reports(spark):
    df = table(spark, [("a", 0.5, 1), ("a", None, 3), ("a", 9.0, 0), ("b", 9.0, None)], "m string, v double, w int")
    assert found(P.pooled_means(df, "m", ["v"], "w")) == [("a", 4, 0.125)]
    x, y = table(spark, [(1, "p"), (2, "q"), (3, None)], "k int, d string"), table(spark, [(1, "p"), (2, "r"), (4, "s"), (3, None)], "k int, d string")
    assert found(P.different(x, y, "k", "d")) == [(2, "q", "r"), (4, None, "s")]
    units = table(spark, [("g", 1, 0), ("g", 1, 0), ("g", 2, 0), ("g", 2, 1)], "g string, c int, s int")
    assert found(P.one_start(units, "g", "c", "s")) == [("g", 1, 2, 0.5)]
    assert found(P.extremes(table(spark, [(1, 2.0), (2, None), (3, 1.0), (4, 2.0)], "id int, v double"), "v", "id", 2)) == sorted([(3, 1.0, "improved"), (1, 2.0, "improved"), (1, 2.0, "worsened"), (4, 2.0, "worsened")], key=str)
    placed = table(spark, [(1, 9, True), (1, 9, None), (2, 9, True), (3, 1, True)], "k int, q int, e boolean")
    assert found(P.evaluable(placed, "k", F.col("e"), "q", 5)) == [(2,)]


@pytest.mark.parametrize(
    "a, b, raw, clash",
    [
        ((5, "A", "C"), (6, "G", "T"), False, False),  # no base shared
        ((5, "A", "C"), (5, "A", "G"), True, True),  # one base changed twice
        ((5, "AC", "A"), (5, "A", "G"), True, False),  # a change on a deletion's padding base
        ((5, "A", "AT"), (5, "A", "AG"), True, True),  # two insertions at one place
        ((5, "AC", "ATC"), (5, "ACGT", "A"), True, False),  # at the edge of a deletion that doesn't spell it
        ((5, "AC", "ATC"), (5, "ACGT", "AT"), True, False),  # the other is trimmed to a deletion beside it
        ((6, "CG", "CTG"), (5, "ACGT", "A"), True, True),  # strictly inside a deletion
        ((5, "AC", "ATC"), (5, "ACG", "ATT"), True, True),  # at an edge where the other's alternative starts so
        ((5, "AAA", "AA"), (5, "AAA", "AA"), True, True),  # one event twice
    ],
)
def test_conflict(spark, a, b, raw, clash):
    at = lambda r: (F.lit(r[0]), F.lit(r[1]), F.lit(r[2]))
    for x, y in ((a, b), (b, a)):
        got = spark.range(1).select(H.conflict(*at(x), *at(y), raw=True), H.conflict(*at(x), *at(y))).first()
        assert tuple(got) == (raw, clash)
