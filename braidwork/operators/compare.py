"""Comparison of methods: quantile summaries, paired differences, rank tests, pooled scores, thresholds, bootstrap, choices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list, midpoints, running_sums


def summary(df: DataFrame, by: Names, value: str, most: bool = True) -> DataFrame:
    """(by, n, median, mean, q1, q3[, max]): nulls are dropped, quantiles are interpolated."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    made = df.groupBy(*_list(by)).agg(F.count(value).alias("n"), q.alias("q_"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return made.select(*_list(by), "n", F.col("q_")[1].alias("median"), "mean", F.col("q_")[0].alias("q1"), F.col("q_")[2].alias("q3"), *(["max"] * most))


def low_quartile(value: str) -> Column:
    """The element at (n - 1) // 4 of the sorted values."""
    s = F.sort_array(F.collect_list(value))
    return F.get(s, F.floor((F.size(s) - 1) / 4).cast("int"))


def upper_median(value: str) -> Column:
    """The element at n // 2 of the sorted values."""
    s = F.sort_array(F.collect_list(value))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def paired(df: DataFrame, by: Names, method: str, value: str, baseline: str) -> DataFrame:
    """(by, method, value, base, diff): values of other methods beside the baseline's, in one aggregation of df by its keys."""
    keys = _list(by)
    both = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(method, value))).alias("m_"))
    rows = both.select(*keys, F.explode("m_").alias(method, value), F.try_element_at("m_", F.lit(baseline)).alias("base"))
    return rows.where((F.col(method) != baseline) & F.col("base").isNotNull()).withColumn("diff", F.col(value) - F.col("base"))


def better_worse(pairs: DataFrame, by: Names, direction: int = -1, tolerance: float = 0.0) -> DataFrame:
    """(by, n, better, worse, equal): direction 1 if more is better."""
    gain = F.col("diff") * direction
    return pairs.groupBy(*_list(by)).agg(F.count("*").alias("n"), F.count_if(gain > tolerance).alias("better"), F.count_if(gain < -tolerance).alias("worse"), F.count_if(F.abs("diff") <= tolerance).alias("equal"))


def complete(df: DataFrame, key: str, method: str, methods: list[str]) -> DataFrame:
    """Rows of df whose key has a row of every method."""
    have = df.where(F.col(method).isin(methods)).groupBy(F.col(key).alias("key_")).agg(F.countDistinct(method).alias("n_")).where(F.col("n_") == len(set(methods)))
    return df.join(have, F.col(key) == F.col("key_"), "left_semi")


def auc(df: DataFrame, score: str, positive: str, by: Names = ()) -> DataFrame:
    """(by, auc): pairs of a positive and a negative in the right order, ties counting half; null without both classes.

    Rows are first counted by score, so what is ordered is a row for each distinct score; without groups, by ranges of it.
    """
    keys = _list(by)
    known = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    counts = known.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    if keys:
        below = W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("before_q", F.coalesce(F.sum("q").over(below), F.lit(0)))
    else:
        placed = running_sums(counts, score, ["q"])
    wins = F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2.0))
    return placed.groupBy(*keys).agg(F.try_divide(wins, (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def threshold_counts(df: DataFrame, feature: str, positive: str) -> DataFrame:
    """(cut, tp, fp, fn, tn) of the rule feature > cut, for each midpoint between neighbouring values and a cut beyond either end.

    A row without the feature is not over any cut, and counts. Rows are first counted by value; running sums and neighbours
    go by ranges of it.
    """
    by = df.groupBy(F.col(feature).alias("v")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"), F.lit(1).alias("one"))
    known = by.where("v IS NOT NULL")
    placed = running_sums(known, "v", ["p", "q", "one"])
    ps, qs, least, most = known.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0)), F.min("v"), F.max("v")).first()
    p0, q0 = by.where("v IS NULL").agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0))).first()
    above = placed.select((F.col("before_one") - 1).alias("n_"), F.col("v").alias("next_"))
    pairs = placed.join(above, F.col("before_one") == F.col("n_"))
    fn, tn = F.col("before_p") + F.col("p"), F.col("before_q") + F.col("q")
    inner = pairs.select(((F.col("v") + F.col("next_")) / 2.0).alias("cut"), (F.lit(ps) - fn).alias("tp"), (F.lit(qs) - tn).alias("fp"), (fn + p0).alias("fn"), (tn + q0).alias("tn"))
    ends = [] if least is None else [(float(least) - 1e-9, ps, qs, p0, q0), (float(most) + 1e-9, 0, 0, ps + p0, qs + q0)]
    return inner.unionByName(df.sparkSession.createDataFrame(ends, "cut double, tp long, fp long, fn long, tn long"))


def balanced_accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (F.try_divide(tp.cast("double"), tp + fn) + F.try_divide(tn.cast("double"), tn + fp)) / 2.0


def best_threshold(df: DataFrame, feature: str, positive: str) -> DataFrame:
    """One row (cut, balanced): the best rule feature > cut; of equal ones the least cut."""
    scored = threshold_counts(df, feature, positive).withColumn("balanced", balanced_accuracy(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))
    return scored.orderBy(F.desc("balanced"), "cut").limit(1).select("cut", "balanced")


def grid_cuts(df: DataFrame, feature: str, most: int) -> list[float]:
    """All midpoints between neighbouring values if they are most at most, else the midpoints at even ranks, so many."""
    placed = running_sums(midpoints(df, feature).distinct().withColumn("one", F.lit(1)), "cut", ["one"])
    n = placed.count()
    picked = placed if n <= most else placed.where(F.col("before_one").isin([i * (n - 1) // (most - 1) for i in range(most)]))
    return sorted(r["cut"] for r in picked.select("cut").collect())


def two_feature_rule(df: DataFrame, a: str, b: str, positive: str, cuts: int = 200, margin: float = 0.02) -> DataFrame:
    """One row (kind, feature, cut_a, cut_b, balanced): the best rule on one feature, or 'and' / 'or' of both if better by the margin.

    Single rules are tried at all midpoints of either feature. Rules of two are tried on a grid of the midpoints, of at most
    cuts for each feature at even ranks where there are more. Rows are counted by cell in one aggregation, and the table of
    cells, which the grid bounds, is summed up on the driver. A row without a feature is over none of its cuts.
    """
    import numpy as np

    singles = [(f, best_threshold(df, f, positive).first()) for f in (a, b)]
    feature, single = max(((f, r) for f, r in singles if r), key=lambda x: (x[1]["balanced"], x[0] == a), default=(None, None))
    fields = "kind string, feature string, cut_a double, cut_b double, balanced double"
    if single is None:
        return df.sparkSession.createDataFrame([], fields)
    grid = [grid_cuts(df, f, cuts) for f in (a, b)]
    over = lambda f, g: F.aggregate(F.array(*map(F.lit, g)) if g else F.array().cast("array<double>"), F.lit(0), lambda n, c: n + (F.coalesce(F.col(f) > c, F.lit(False))).cast("int"))
    cells = df.groupBy(over(a, grid[0]).alias("i"), over(b, grid[1]).alias("j")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q")).collect()
    n = np.zeros((2, len(grid[0]) + 1, len(grid[1]) + 1))
    for r in cells:
        n[0, r["i"], r["j"]], n[1, r["i"], r["j"]] = r["p"], r["q"]
    total = n.sum((1, 2), keepdims=True)
    both = n[:, ::-1, ::-1].cumsum(1).cumsum(2)[:, ::-1, ::-1]  # over at least so many cuts of each
    one, two = both[:, :, :1], both[:, :1, :]
    best = (single["balanced"] + margin, None)
    for kind, hit in (("and", both), ("or", one + two - both)):
        with np.errstate(invalid="ignore", divide="ignore"):
            score = ((hit[0] / total[0] + (total[1] - hit[1]) / total[1]) / 2.0)[1:, 1:]
        if score.size and (np.nanmax(score) > best[0] if best[1] else np.nanmax(score) >= best[0]):
            i, j = np.unravel_index(np.nanargmax(score), score.shape)
            best = (float(score[i, j]), (kind, "both", grid[0][i], grid[1][j], float(score[i, j])))
    alone = ("single", feature, single["cut"] if feature == a else None, single["cut"] if feature == b else None, single["balanced"])
    return df.sparkSession.createDataFrame([best[1] or alone], fields)


def signed_rank_p(diffs) -> float | None:
    """Two-sided p of the signed-rank test: zeros dropped, ties ranked on average, exact up to 60 values, else normal with corrections."""
    d = sorted((x for x in diffs if x), key=abs)
    n = len(d)
    if not n:
        return None
    ranks, i = [0.0] * n, 0
    ties = 0
    while i < n:
        j = i
        while j < n and abs(d[j]) == abs(d[i]):
            j += 1
        for k in range(i, j):
            ranks[k] = (i + j + 1) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    if n <= 60:
        ways, doubled = {0: 1}, [round(2 * r) for r in ranks]
        for r in doubled:
            new = dict(ways)
            for s, w in ways.items():
                new[s + r] = new.get(s + r, 0) + w
            ways = new
        low = min(round(2 * plus), sum(doubled) - round(2 * plus))
        return min(1.0, 2 * sum(w for s, w in ways.items() if s <= low) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(max(0.0, abs(plus - mean) - 0.5) / math.sqrt(2 * var))


def signed_rank(df: DataFrame, by: Names, diff: str) -> DataFrame:
    """(by, p): signed_rank_p of each group. Equal sizes are collapsed first, so a group sends its distinct values only."""
    import pandas as pd

    keys = _list(by)
    types = dict(df.dtypes)
    fields = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "p double"])
    counted = df.where(F.col(diff).isNotNull()).groupBy(*keys, F.col(diff).cast("double").alias("d_")).agg(F.count("*").alias("n_"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = signed_rank_p(pdf["d_"].repeat(pdf["n_"]).tolist())
        return pdf[keys].iloc[:1].assign(p=p)

    return counted.groupBy(*keys).applyInPandas(run, fields)


def poisson_edges() -> list[float]:
    """Chances of at most 0, 1, ... of a Poisson number of mean 1, as far as they grow in double precision."""
    edges, at, term = [], 0.0, math.exp(-1.0)
    while at + term > at:
        at += term
        edges.append(at)
        term /= len(edges)
    return edges


def uniform_by_md5(seed: int, draw: Column, ident: Column) -> Column:
    """A number between 0 and 1 of 52 bits of an MD5 digest, which other engines have too; slower than the hash of bootstrap_ratio."""
    bits = F.conv(F.substr(F.md5(F.concat_ws("/", F.lit(str(seed)), draw.cast("string"), ident.cast("string"))), F.lit(1), F.lit(13)), 16, 10)
    return (bits.cast("long").cast("double") + 0.5) / float(1 << 52)


def bootstrap_difference(df: DataFrame, by: Names, diff: str, ident: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """(by, n, total, low, high): the sum of paired differences and its interval over draws of as many differences.

    Draws weigh each difference by a Poisson number; a draw's sum is its mean times n, so the number drawn doesn't spread it.
    Null differences are left out.
    """
    keys = _list(by)
    found = df.where(F.col(diff).isNotNull()).withColumn("one_", F.lit(1))
    means = bootstrap_ratio(found, keys, diff, "one_", ident, draws, seed, uniform_by_md5)
    counted = found.groupBy(*(F.col(k).alias(f"{k}___") for k in keys)).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}___"))
    return means.join(counted, same).select(*keys, "n", *((F.col(a) * F.col("n")).alias(b) for a, b in (("ratio", "total"), ("low", "low"), ("high", "high"))))


#: A prime of 31 bits; fifth powers permute its remainders.
DRAW_PRIME = (1 << 31) - 1


def uniform_by_power(key: Column, step: Column, draw: Column) -> Column:
    """A number between 0 and 1 of each draw: the fifth power of key + draw * step modulo DRAW_PRIME. Long arithmetic only."""
    p = F.lit(DRAW_PRIME)
    v = (key + draw * step) % p
    second = (v * v) % p
    return (((second * second) % p * v) % p).cast("double") / float(DRAW_PRIME) + 0.5 / DRAW_PRIME


WHOLE = ("tinyint", "smallint", "int", "bigint")


@lru_cache(1)
def draw_weights():
    """(thresholds, table): a draw's number is that of the thresholds below it; by its upper bits where these tell, else 255."""
    import numpy as np

    def least(edge: float) -> int:
        """The greatest remainder whose number between 0 and 1 is not above edge."""
        low, high = -1, DRAW_PRIME - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid / float(DRAW_PRIME) + 0.5 / DRAW_PRIME <= edge else (low, mid - 1)
        return low

    at = np.array([least(e) for e in poisson_edges()])
    first = np.arange(1 << 16) << 15
    one, two = np.searchsorted(at, first), np.searchsorted(at, first + (1 << 15) - 1)
    return at, np.where(one == two, one, 255).astype(np.uint8)


def drawn_weights(key, step, draws: int):
    """The Poisson numbers of rows x draws by uniform_by_power; remainders by the Mersenne prime are sums of a number's two halves."""
    import numpy as np

    fold = lambda x: (x & DRAW_PRIME) + (x >> 31)
    v = fold(key[:, None] + step[:, None] * np.arange(1, draws + 1))
    second = fold(fold(v * v))
    v = fold(fold(fold(fold(second * second)) * v))
    v[v >= DRAW_PRIME] -= DRAW_PRIME
    at, table = draw_weights()
    w = table[v >> 15]
    open_ = w == 255
    w[open_] = np.searchsorted(at, v[open_])
    return w


#: Rows drawn at once, and groups whose sums a task holds before it passes them on.
DRAW_ROWS, DRAW_GROUPS = 16, 256


def drawn_sums(rows: DataFrame, keys: list[str], num: str, den: str, draws: int) -> DataFrame:
    """(keys, draw, n_, d_): partial sums of num and den by draw of rows (keys, num, den, k_, j_), made in tasks. Whole numbers add up exactly."""
    kinds = dict(rows.dtypes)
    whole = [kinds[c] in WHOLE for c in (num, den)]
    fields = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["draw int"] + [f"{c} {'bigint' if w else 'double'}" for c, w in zip(("n_", "d_"), whole, strict=True)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[tuple, list] = {}
        schema = None

        def flush():
            given, sums = list(held), list(held.values())
            cols = [pa.array([g[i] for g in given for _ in range(draws)], schema.field(k).type) for i, k in enumerate(keys)]
            cols.append(pa.array(np.tile(np.arange(1, draws + 1, dtype=np.int32), len(given))))
            for c in (0, 1):
                made = np.concatenate([s[c] for s in sums])
                cols.append(pa.array(made, mask=np.repeat([not s[2 + c] for s in sums], draws)))
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "draw", "n_", "d_"])

        for batch in batches:
            schema = batch.schema
            of: dict[tuple, list[int]] = {}
            for nth, g in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * batch.num_rows):
                of.setdefault(g, []).append(nth)
            values, valid = [], []
            for c, w in zip((num, den), whole, strict=True):
                col = batch.column(c)
                valid.append(np.asarray(col.is_valid()))
                values.append(np.asarray(col.fill_null(0)).astype(np.int64 if w else np.float64))
            k, j = (np.asarray(batch.column(c)) for c in ("k_", "j_"))
            for g, members in of.items():
                if g not in held:
                    if len(held) >= DRAW_GROUPS:
                        yield flush()
                    held[g] = [np.zeros(draws, np.int64 if w else np.float64) for w in whole] + [False, False]
                sums = held[g]
                for at in range(0, len(members), DRAW_ROWS):
                    some = np.array(members[at : at + DRAW_ROWS])
                    w = drawn_weights(k[some], j[some], draws).astype(np.float64)
                    for c in (0, 1):
                        x = values[c][some]
                        if whole[c]:  # three parts of 22 bits, whose sums a double holds exactly
                            low = (1 << 22) - 1
                            for shift, p in ((0, x & low), (22, (x >> 22) & low), (44, x >> 44)):
                                if p.any():
                                    sums[c] += np.einsum("rd,r->d", w, p.astype(np.float64)).astype(np.int64) << shift
                        else:
                            sums[c] += np.einsum("rd,r->d", w, x)
                        sums[2 + c] |= bool(valid[c][some].any())
        if held:
            yield flush()

    return rows.mapInArrow(run, fields)


def bootstrap_ratio(df: DataFrame, by: Names, num: str, den: str, ident: str, draws: int = 1000, seed: int = 7, uniform=None) -> DataFrame:
    """(by, ratio, low, high): ratio of sums and its interval over draws that weigh each row by a Poisson number.

    The number comes from a digest of seed and id, taken once a row, and the draw, so it is the same wherever the row is. The
    columns needed are dealt over spark.sql.shuffle.partitions tasks first, since a row costs a thousand times what its bytes
    tell; each meets each draw in its task, a block of rows and all draws at a time, and only sums by draw are shuffled. uniform: another (seed, draw, id) to the number.
    """
    keys = _list(by)
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(ident).cast("string")))
    part = lambda at: F.conv(F.substr("m_", F.lit(at), F.lit(7)), 16, 10).cast("long")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = uniform or any(dict(df.dtypes)[c] not in (*WHOLE, "float", "double") for c in (num, den))
    df = df if uniform else df.withColumn("m_", digest).withColumns({"k_": part(1), "j_": part(8)}).drop("m_")
    dealt = df.select(*dict.fromkeys([*keys, num, den, *([ident] if uniform else ["k_", "j_"])])).repartition(parts)
    if plain:
        u = uniform(seed, F.col("draw"), F.col(ident)) if uniform else uniform_by_power(F.col("k_"), F.col("j_"), F.col("draw"))
        edges = poisson_edges()
        weight = F.when(F.col("u_") <= edges[0], 0)
        for k, e in enumerate(edges[1:], 1):  # most draws end at the first two
            weight = weight.when(F.col("u_") <= e, k)
        weight = weight.otherwise(len(edges))
        drawn = dealt.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u_", u).withColumn("w_", weight)
        sums = drawn.groupBy(*keys, "draw").agg(F.sum(F.col("w_") * F.col(num)).alias("n_"), F.sum(F.col("w_") * F.col(den)).alias("d_"))
    else:
        sums = drawn_sums(dealt, keys, num, den, draws).groupBy(*keys, "draw").agg(F.sum("n_").alias("n_"), F.sum("d_").alias("d_"))
    s = F.sort_array(F.collect_list(F.try_divide("n_", "d_")))
    spread = sums.groupBy(*keys).agg(s.alias("s_")).select(*(F.col(k).alias(f"{k}__") for k in keys), F.get("s_", F.floor(F.size("s_") * 0.025).cast("int")).alias("low"), F.get("s_", (F.ceil(F.size("s_") * 0.975) - 1).cast("int")).alias("high"))
    whole = df.groupBy(*keys).agg(F.try_divide(F.sum(num).cast("double"), F.sum(den)).alias("ratio"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return whole.join(spread, same).select(*keys, "ratio", "low", "high")


def replicate_rule(df: DataFrame, key: str, label: str, value: str, a: str, b: str) -> DataFrame:
    """(key, verdict): of labels a and b with two replicates each at least, 'better' if all of a's are below all of b's, 'worse' if above."""
    of = lambda f, x: f(F.when(F.col(label) == x, F.col(value)))
    n = lambda x: F.count_if((F.col(label) == x) & F.col(value).isNotNull())
    by = df.groupBy(key).agg(of(F.min, a).alias("la"), of(F.max, a).alias("ha"), of(F.min, b).alias("lb"), of(F.max, b).alias("hb"), n(a).alias("na"), n(b).alias("nb"))
    return by.where("na > 1 AND nb > 1").select(key, F.when(F.col("ha") < F.col("lb"), "better").when(F.col("la") > F.col("hb"), "worse").otherwise("tie").alias("verdict"))


def noise_rule(pairs: DataFrame, noise_a: str, noise_b: str) -> DataFrame:
    """pairs (diff) with verdict: better only below minus the summed noise, worse only above it."""
    noise = F.coalesce(F.col(noise_a), F.lit(0)) + F.coalesce(F.col(noise_b), F.lit(0))
    return pairs.withColumn("verdict", F.when(F.col("diff") < -noise, "better").when(F.col("diff") > noise, "worse").otherwise("equal"))


def sampled(df: DataFrame, by: Names, ident: list[str], k: int, seed: str, always: Column | None = None) -> DataFrame:
    """k rows of each group in the order of an MD5 of seed and ids, besides those that always stay."""
    stays = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    h = F.md5(F.concat_ws("-", F.lit(seed), *(F.col(c).cast("string") for c in ident)))
    w = W.partitionBy(*_list(by), "stays_").orderBy("hash_", *ident)
    return df.withColumn("stays_", stays).withColumn("hash_", h).withColumn("nth_", F.row_number().over(w)).where(F.col("stays_") | (F.col("nth_") <= k)).drop("stays_", "hash_", "nth_")


def weighted_sample(df: DataFrame, by: Names, ident: list[str], weight: str, k: int, seed: str) -> DataFrame:
    """k rows of each group drawn without return by weight: the least of -ln(u) / weight, u from a hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *ident), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    w = W.partitionBy(*_list(by)).orderBy("draw_", *ident)
    return df.where(F.col(weight) > 0).withColumn("draw_", -F.ln(u) / F.col(weight)).withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= k).drop("draw_", "nth_")


def choice(df: DataFrame, by: Names, score: str, order: str, pick: str) -> DataFrame:
    """(by, pick): the row with the greatest score, ties to the least order."""
    return df.where(F.col(score).isNotNull()).groupBy(*_list(by)).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(order), F.col(pick).alias("p"))).alias("b_")).select(*_list(by), F.col("b_.p").alias(pick))


def against_baseline(df: DataFrame, key: str, strategy: str, score: str, base: str, eps: float) -> DataFrame:
    """(strategy, n, median, quartile, better, worse): scores over all keys of the baseline, its own score where one is missing."""
    b = df.where(F.col(strategy) == base).select(F.col(key).alias("key_"), F.col(score).alias("base_"))
    names = [r[0] for r in df.where(F.col(strategy).isNotNull()).select(strategy).distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10000 strategies")
    grid = b.withColumn("strategy_", F.explode(F.array(*map(F.lit, names))))
    own = df.select(F.col(key).alias("k2"), F.col(strategy).alias("s2"), F.col(score).alias("own_"))
    filled = grid.join(own, (F.col("key_") == F.col("k2")) & (F.col("strategy_") == F.col("s2")), "left").withColumn("v_", F.coalesce("own_", "base_"))
    return filled.groupBy(F.col("strategy_").alias(strategy)).agg(F.count("v_").alias("n"), F.percentile("v_", F.lit(0.5)).alias("median"), low_quartile("v_").alias("quartile"), F.count_if(F.col("v_") > F.col("base_") + eps).alias("better"), F.count_if(F.col("v_") < F.col("base_") - eps).alias("worse"))


def run_summary(df: DataFrame, by: Names, status: str, seconds: str) -> DataFrame:
    """(by, ok, refused, timeout, memout, failed, median, p90, max, hours): seconds of the runs that ended well."""
    ok = F.when(F.col(status) == "ok", F.col(seconds))
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("ok", "refused", "timeout", "memout")]
    other = F.count_if(~F.col(status).isin("ok", "refused", "timeout", "memout")).alias("failed")
    return df.groupBy(*_list(by)).agg(*counts, other, F.percentile(ok, F.lit(0.5)).alias("median"), F.percentile(ok, F.lit(0.9)).alias("p90"), F.max(ok).alias("max"), (F.sum(ok) / 3600).alias("hours"))


def outcome(status: str, seconds: str, limit: float) -> Column:
    """ok, timeout, memout, refused or error of a run."""
    s = F.lower(F.coalesce(F.col(status), F.lit("")))
    return F.when(s == "ok", "ok").when((s == "timeout") | (F.col(seconds) >= limit), "timeout").when(s.rlike("mem|oom|killed"), "memout").when(s.rlike("refus|skip|not run"), "refused").otherwise("error")


def pooled(df: DataFrame, by: Names, counts: tuple[str, str, str, str] = ("tp_base", "fn", "tp_comp", "fp")) -> DataFrame:
    """(by, the four counts, f1): summed over the rows that have all four."""
    from braidwork.functions.sequences import f1_pooled

    have = F.lit(True)
    for c in counts:
        have = have & F.col(c).isNotNull()
    made = df.where(have).groupBy(*_list(by)).agg(*(F.sum(c).alias(c) for c in counts))
    return made.withColumn("f1", f1_pooled(*(F.col(c) for c in counts)))
