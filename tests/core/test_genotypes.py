"""Best pairs of alleles against loops over all pairs."""

import math
import random

from braidwork.operators import genotypes as G


def best(pairs):
    """The greatest, the first on ties, as a loop over i <= j keeps it."""
    return max(pairs, key=lambda p: (round(pairs[p][0], 9), -p[0], -p[1]))


def test_pairs_with_depth_and_mixtures(spark):
    rng = random.Random(6)
    distances, lengths, depths, priors, want, flat, weighted = [], [], [], [], {}, {}, {}
    for g in range(8):
        n, reads, kappa = rng.randint(1, 4), rng.randint(1, 9), rng.choice([None, 0.0, 0.05])
        d = [[rng.randint(0, 3) for _ in range(n)] for _ in range(reads)]
        e = [rng.choice([0.01, 0.1]) for _ in range(reads)]
        size = [rng.randint(50, 200) for _ in range(n)]
        distances += [(g, r, a, d[r][a], e[r], math.exp(-d[r][a])) for r in range(reads) for a in range(n)]
        lengths += [(g, a, size[a]) for a in range(n)]
        depths += [(g, kappa)] * (kappa is not None)
        deep, half, long = {}, {}, {}
        for i in range(n):
            for j in range(i, n):
                ll = sum(math.log(0.5 * math.exp(-3.0 * x[i]) + 0.5 * math.exp(-3.0 * x[j])) for x in d)
                if kappa:
                    mu = kappa * (size[i] + size[j] + 2 * 149)
                    ll += reads * math.log(mu) - mu - math.lgamma(reads + 1)
                deep[i, j] = (ll,)
                prior = (i - j) * 0.3
                priors.append((g, i, j, prior))
                for made, w in ((half, 0.5), (long, size[i] / (size[i] + size[j]))):
                    made[i, j] = (sum(math.log((1 - p) * (w * math.exp(-x[i]) + (1 - w) * math.exp(-x[j])) + p) for x, p in zip(d, e, strict=True)) + prior,)
        want[g], flat[g], weighted[g] = (best(x) for x in (deep, half, long))
        want[g] = (*want[g], round(deep[want[g]][0], 6), reads)
    frame = spark.createDataFrame(distances, "region int, read int, allele int, d int, e double, rel double")
    sizes, prior = spark.createDataFrame(lengths, "region int, allele int, len int"), spark.createDataFrame(priors, "region int, i int, j int, prior double")
    got = G.best_pairs(G.pair_likelihoods(frame, sizes, spark.createDataFrame(depths, "region int, kappa double"), 3.0, 150)).collect()
    assert {r.region: (r.i, r.j, round(r.ll, 6), r.reads) for r in got} == want
    for by_length, found in ((False, flat), (True, weighted)):
        made = G.best_pairs(G.mixture_likelihoods(frame, sizes, by_length, prior)).collect()
        assert {r.region: (r.i, r.j) for r in made} == found
    assert G.best_pairs(G.mixture_likelihoods(frame.limit(0), sizes)).collect() == []


def test_mixtures_of_both_kinds_read_the_scores_once(spark):
    scores = spark.range(40).selectExpr("id % 3 AS region", "id AS read", "explode(array(0, 1, 2)) AS allele", "0.1D AS e").selectExpr("*", "exp(-((read * 7 + allele * 3) % 5)) AS rel")
    lengths = spark.range(3).selectExpr("id AS region", "explode(array(0, 1)) AS allele").selectExpr("*", "100 + region * 7 + allele * 50 AS len")
    made = G.mixture_fits(scores, lengths)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(region") == 2 and plan.count("Exchange") == 2
    both = {(r.region, r.i, r.j): r for r in made.collect()}
    assert len(both) == 9  # allele 2 has no length
    at = {(r.region, r.read, r.allele): r.rel for r in scores.collect()}
    size = {(r.region, r.allele): r.len for r in lengths.collect()}
    for (g, i, j), r in both.items():
        own = sorted({read for h, read, _ in at if h == g})
        for got, w in ((r.flat, 0.5), (r.weighted, size[g, i] / (size[g, i] + size[g, j]))):
            assert abs(got - sum(math.log(0.9 * (w * at[g, x, i] + (1 - w) * at[g, x, j]) + 0.1) for x in own)) < 1e-9
        assert r.reads == len(own)
