"""Quality classifier: a sparse ensemble of rules over a text's statistics, compiled into Spark columns.

Statistics are column expressions. On a bounded sample of labelled rows, boosted trees are grown on the driver, every path
from their roots becomes a conjunctive rule, and a lasso logistic regression over rules and statistics keeps few of them.
The kept rules are compiled into one column expression, so scoring is a projection without any Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import WORD, chars_of, held_out, let, table
from braidwork.llm.quality_rules import line_repeats, repeat_words, word_hashes

#: Labelled rows that the model is fitted on at most, chosen by a hash of their ids.
SAMPLE = 20_000
TREES, DEPTH, CUTS, LEARNING, LEAST_LEAF = 40, 3, 32, 0.2, 15
LASSO, STEPS = 0.002, 400
FEATURES = ["n_words", "word_length", "distinct", "repeated", "dup_lines", "line_words", "symbols", "upper", "digits", "punctuation", "stops", "bars", "exclaims", "letters", "longest_line"]


def statistics(text: Column) -> Column:
    """struct of FEATURES, doubles, of a non-null text; ratios without a denominator are 0."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    only = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    lines = only("\n") + 1

    def of(h: Column) -> Column:
        n = F.size(h).cast("double")
        some = F.greatest(n, F.lit(1.0))
        return F.struct(
            F.log1p(n).alias("n_words"),
            (chars_of(text, WORD[:-1]) / some).alias("word_length"),
            (F.size(F.array_distinct(h)) / some).alias("distinct"),
            (repeat_words(h) / some).alias("repeated"),
            (line_repeats(text) / lines).cast("double").alias("dup_lines"),
            F.log1p(n / lines).alias("line_words"),
            (chars_of(text, "[#*$%&<>]") / chars).alias("symbols"),
            (chars_of(text, "\\p{Lu}") / chars).alias("upper"),
            (chars_of(text, "[0-9]") / chars).alias("digits"),
            (chars_of(text, "[.,;:?'\"()]") / chars).alias("punctuation"),
            (only(".") / some).alias("stops"),
            (only("|") / some).alias("bars"),
            (only("!") / some).alias("exclaims"),
            (chars_of(text, "\\p{L}") / chars).alias("letters"),
            F.log1p(F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))).alias("longest_line"),
        )

    return let(word_hashes(text), of)


@dataclass
class Rule:
    """Weight of a conjunction of (feature, is over the bound, bound)."""

    conditions: list[tuple[str, bool, float]]
    weight: float = 0.0


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    #: feature: (weight, least, most, scale), for winsorised statistics
    linear: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def logit(self, s: Column) -> Column:
        """The compiled ensemble over a struct of statistics."""
        out = F.lit(self.bias)
        for name, (weight, least, most, scale) in self.linear.items():
            out = out + F.lit(weight) * F.greatest(F.lit(least), F.least(F.lit(most), s[name])) / F.lit(scale)
        for rule in self.rules:
            holds = F.lit(True)
            for name, over, bound in rule.conditions:
                holds = holds & ((s[name] > bound) if over else (s[name] <= bound))
            out = out + F.when(holds, F.lit(rule.weight)).otherwise(0.0)
        return out


def _tree(x, bounds, residual, hessian, depth: int, rows, path, out, names) -> None:
    """Grows a regression tree on binned columns x and appends (path, rows, value) of each node to out."""
    import numpy as np

    best = (1e-9, None)
    g, h = residual[rows], hessian[rows]
    if depth and len(rows) >= 2 * LEAST_LEAF:
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            n = len(bounds[f]) + 1
            if n < 2:
                continue
            b = x[rows, f]
            gs, hs, cs = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            gain[(cs < LEAST_LEAF) | (len(rows) - cs < LEAST_LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if path:
        out.append((tuple(path), rows, best[1] is None))
    if best[1] is None:
        return
    f, k = best[1]
    over = x[rows, f] > k
    for side in (False, True):
        _tree(x, bounds, residual, hessian, depth - 1, rows[over == side], [*path, (names[f], side, float(bounds[f][k]))], out, names)


def fit_arrays(values, labels, names: list[str] = FEATURES) -> Ensemble:
    """values: rows x features; labels: 0 or 1. Without both labels the ensemble is a constant."""
    import numpy as np

    values, y = np.asarray(values, np.float64), np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else 4.0 * (2 * y[0] - 1))
    bounds = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(values.shape[1])]
    x = np.stack([np.searchsorted(b, values[:, f], side="left") for f, b in enumerate(bounds)], 1)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, object] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        nodes: list = []
        _tree(x, bounds, y - p, p * (1 - p), DEPTH, np.arange(len(y)), [], nodes, names)
        if not nodes:
            break
        for path, rows, leaf in nodes:
            found.setdefault(path, rows)
            if leaf:
                score[rows] += LEARNING * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1.0)
    paths = list(found)
    least, most = np.quantile(values, 0.025, 0), np.quantile(values, 0.975, 0)
    clipped = np.clip(values, least, most)
    scale = clipped.std(0) / 0.4
    used = np.flatnonzero(scale > 1e-9)
    columns = np.zeros((len(y), len(paths) + len(used)))
    for i, path in enumerate(paths):
        columns[found[path], i] = 1
    columns[:, len(paths) :] = clipped[:, used] / scale[used]
    weights, bias = _lasso(columns, y)
    kept = [Rule(list(path), float(w)) for path, w in zip(paths, weights, strict=False) if w]
    linear = {names[f]: (float(w), float(least[f]), float(most[f]), float(scale[f])) for f, w in zip(used, weights[len(paths) :], strict=True) if w}
    return Ensemble(float(bias), kept, linear)


def _lasso(x, y):
    """Logistic regression with an absolute-value penalty, by accelerated proximal steps."""
    import numpy as np

    mean = x.mean(0)
    centred = x - mean
    step = 4 * len(y) / max(np.linalg.norm(centred, 2) ** 2, 1e-12)
    w = z = np.zeros(x.shape[1])
    b, t = np.log(y.mean() / (1 - y.mean())), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(centred @ z + b)))
        b += 2 * (y - p).mean()
        new = z + step * (centred.T @ (y - p)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w, b - mean @ w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = SAMPLE) -> Ensemble:
    """The ensemble fitted on docs that have a non-null 0/1 label; on limit of them at most, in the order of a hash of the key."""
    chosen = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key_")).agg(F.max(label).alias("label_"))
    chosen = chosen.where("key_ IS NOT NULL").orderBy(F.xxhash64("key_"), "key_").limit(limit)
    read = docs.select(F.col(key).alias("doc_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    rows = read.join(F.broadcast(chosen), F.col("doc_") == F.col("key_")).select(statistics(F.col("text_")).alias("s"), "label_")
    found = rows.select(*(F.col("s")[n].alias(n) for n in FEATURES), "label_").toPandas().sort_values([*FEATURES, "label_"])
    return fit_arrays(found[FEATURES].to_numpy(), found["label_"].to_numpy())


def score(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5). Columns of docs with these names give way.

    Null texts are empty ones, and empty texts have a score too. Only the text is read, so repeated rows agree.
    """
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    read = docs.select(*own, statistics(F.coalesce(F.col(text), F.lit(""))).alias("stats_"))
    scored = read.select(*own, (1 / (1 + F.exp(-model.logit(F.col("stats_"))))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(~held_out("doc_id", 3, 1))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
