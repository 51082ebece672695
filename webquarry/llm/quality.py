"""Quality by hierarchical empirical Bayes: a document's own evidence, shrunk site by site towards the global prior.

Method. A logistic regression over `FEATURES` of the text gives each document's evidence, the probability of good quality. Evidence is summed up
by path and by host. A host's posterior is a beta posterior around the global mean, a path's one around its host's posterior; how strongly
they shrink is estimated from all sites by the method of moments (spread between sites against spread inside), so sparse sites stay near
their parent. A document's quality is its evidence moved by the log odds of its path against the global mean; both posteriors leave the document's
own evidence out, so that it counts once, however small its site is.

The regression is fitted on the driver on a bounded sample, about `SAMPLE` labelled documents by the hash of their id; evidence, sums and
posteriors cover all documents. Only three sums a level are collected; hosts are never one group in a task.

Defined results: a null text is an empty one; null hosts and paths are sites of their own; without labels of both kinds the evidence is
1/2 throughout; repeated rows and null ids are rows like others; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

SAMPLE = 20_000
#: Documents under this quality go.
KEEP = 0.5
RIDGE = 1e-3
SMALL = 100_000
FEATURES = ("log_words", "word_length", "letters", "digits", "spaces", "symbols", "symbol_kinds", "upper", "distinct_words", "top_word", "repeated_neighbours", "lines", "distinct_lines", "short_words", "stops")

#: Marks of ordinary prose; others are symbols.
_PROSE = ".,;:!?'\"()-"
_CLASSES = ("other", "lower", "upper", "digit", "space", "prose", "symbol")
_STOP = re.compile(r"[.!?](?:\s|$)")


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point, made once a worker."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind, char = unicodedata.category(chr(c)), chr(c)
        if char.isspace():
            out[c] = 4
        elif char in _PROSE:
            out[c] = 5
        elif kind[0] in "PS":
            out[c] = 6
        elif kind[0] == "L":
            out[c] = 2 if kind == "Lu" else 1
        elif kind[0] == "N":
            out[c] = 3
    return out


def features(text: str | None) -> list[float]:
    """Shares and sizes of a whole text; counts are over all of it."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = _classes()[points]
    kinds = np.bincount(classes, minlength=len(_CLASSES)) / max(1, len(points))
    words = text.split()
    total, counts = max(1, len(words)), Counter(words)
    lines = text.split("\n")
    return [
        np.log1p(len(words)), min(20.0, sum(map(len, words)) / total), kinds[1] + kinds[2], kinds[3], kinds[4],
        kinds[6], len(np.unique(points[classes == 6])) / 10, kinds[2], len(counts) / total, max(counts.values(), default=0) / total,
        sum(map(str.__eq__, words, words[1:])) / total, np.log1p(len(lines)), len(set(lines)) / len(lines),
        sum(len(w) * n for w, n in counts.items() if len(w) <= 2) / total, len(_STOP.findall(text)) / total,
    ]


class Regression:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._columns(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (y - p) / len(y) - ridge * self.weights
            curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(curve, slope)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._columns(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "quality", sample: int = SAMPLE) -> Regression | None:
    """The regression on about `sample` labelled documents; None unless both kinds occur. A document labelled twice counts with its lower label."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(F.col(target).cast("int")).alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)))
    picked = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t")).join(F.broadcast(known.where(draw)), "__id")  # about `sample` ids

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"id": pdf["__id"], "x": [features(t) for t in pdf["t"]], "y": pdf["y"]})

    rows = sorted((r["id"], r["x"], r["y"]) for r in picked.mapInPandas(run, "id long, x array<double>, y int").collect())
    y = np.array([r[2] > 0 for r in rows], float)
    return Regression(np.array([r[1] for r in rows]), y) if 0 < y.sum() < len(y) else None


def evidence(spark: SparkSession, model: Regression | None):
    """A column function from text to the probability of good quality."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predicted(texts):
        import pandas as pd

        if shared.value is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(shared.value.predict(np.array([features(t) for t in texts])))

    return predicted.asNondeterministic()


def _strength(sites: DataFrame, p: str, n: str, parent: Column, mean: float, parents: int) -> float:
    """Prior observations of a level: a beta-binomial's, by moments of the sites' means around their parents'."""
    gap = F.col(p) / F.col(n) - parent
    row = sites.agg(F.sum(F.col(n) * gap * gap), F.count("*"), F.sum(n), F.sum(F.col(n).cast("double") * F.col(n))).first()
    spread, count, total, squares = (float(x or 0) for x in row)
    inside, free = max(mean * (1 - mean), 1e-9), count - parents
    room = total - squares / max(total, 1.0) - free
    if free <= 0 or room <= 0:
        return 1e6
    share = min(max((spread - free * inside) / (inside * room), 1e-6), 1 - 1e-6)
    return 1 / share - 1


def posteriors(scored: DataFrame) -> DataFrame:
    """host, path, host_posterior, path_posterior, prior from rows (host, path, evidence), with the sums (p, n, hp, hn) and strengths they are made of."""
    paths = common.cut(scored.groupBy("host", "path").agg(F.sum("evidence").alias("p"), F.count("*").alias("n")))
    hosts = common.cut(paths.groupBy("host").agg(F.sum("p").alias("hp"), F.sum("n").alias("hn")))
    p, n, count = (float(x or 0) for x in hosts.agg(F.sum("hp"), F.sum("hn"), F.count("*")).first())
    mean = p / n if n else 0.5
    host_weight = _strength(hosts, "hp", "hn", F.lit(mean), mean, 1)
    own = hosts.withColumn("host_posterior", (F.lit(host_weight * mean) + F.col("hp")) / (F.lit(host_weight) + F.col("hn"))).withColumnRenamed("host", "__host")
    both = paths.join(own, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    path_weight = _strength(both, "p", "n", F.col("hp") / F.col("hn"), mean, int(count))
    posterior = (F.lit(path_weight) * F.col("host_posterior") + F.col("p")) / (F.lit(path_weight) + F.col("n"))
    strengths = [F.lit(host_weight).alias("host_weight"), F.lit(path_weight).alias("path_weight")]
    return both.select("host", "path", "host_posterior", posterior.alias("path_posterior"), F.lit(mean).alias("prior"), "p", "n", "hp", "hn", *strengths)


def _without(weight: str, parent: Column, total: str, n: str) -> Column:
    """A posterior without the evidence of the row itself."""
    rest = F.greatest(F.col(total) - F.col("evidence"), F.lit(0.0))
    return (F.col(weight) * parent + rest) / (F.col(weight) + F.col(n) - 1)


def _odds(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(inside / (1 - inside))


def judge(docs: DataFrame, model: Regression | None, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, quality, kept for each row; its posteriors are those of the other rows of its site."""
    score = evidence(docs.sparkSession, model)
    scored = common.cut(docs.select(F.col(doc_id).alias("doc_id"), host.alias("host"), path.alias("path"), score(F.col(text)).alias("evidence")))
    sites = common.cut(posteriors(scored).drop("host_posterior", "path_posterior").withColumnsRenamed({"host": "__host", "path": "__path"}))
    small = F.broadcast(sites) if sites.count() <= SMALL else sites
    both = scored.join(small, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    both = both.withColumn("host_posterior", _without("host_weight", F.col("prior"), "hp", "hn"))
    both = both.withColumn("path_posterior", _without("path_weight", F.col("host_posterior"), "p", "n"))
    odds = _odds(F.col("evidence")) + _odds(F.col("path_posterior")) - _odds(F.col("prior"))
    quality = 1 / (1 + F.exp(-odds))
    found = both.withColumn("quality", quality)
    return found.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages inside a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model, F.col("source"), F.col("lang"))
