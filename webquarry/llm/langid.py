"""Language identification: presence kernels of blended n-grams, Nystrom landmarks, one-versus-rest kernel ridge regression.

Method. The kernel of two texts is the number of n-grams (1 to 3 characters, lower case, blended) that are present in both, divided by the
geometric mean of their numbers of different n-grams. `landmarks` texts of the training sample span the feature space (Nystrom); ridge
regression of +1 and -1 for each language on the landmarks' features gives one column of weights a language. Scoring holds a batch of texts
as a presence matrix over the landmarks' n-grams and takes two matrix products: presence by landmarks, kernel by weights.

The fit is on the driver from a bounded sample: about `PER_LANGUAGE` documents of each language, `ROWS` in all, of any length, picked by the hash of
their id; landmarks are the first of them by that hash, in turn from each language, and with more languages than landmarks some have none and are
told by the others' features. Tasks turn the picked texts into their different n-grams, so that the driver holds no text; of a very long one the `GRAMS`
with the smallest hashes, and the model keeps `VOCABULARY` n-grams, so that its size is bounded. Scoring covers every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could be learnt (`keep_identified`
then keeps all texts with a letter, their language as it was); score is the
winner's regression value taken from [-1, 1] to [0, 1]; ties go to the smaller language; very long texts are read in pieces; repeated rows
and null ids are rows like others; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import common

ORDERS = (1, 2, 3)
PER_LANGUAGE = 400
LANDMARKS = 160
RIDGE = 1e-2
UNKNOWN = "und"
#: Rows of the training sample in all; n-grams of one of its texts; n-grams of all landmarks.
ROWS, GRAMS, VOCABULARY = 8000, 20_000, 120_000
#: Texts whose presence rows make one matrix.
BATCH = 64
_PIECE = 1 << 20


def ngrams(text: str) -> np.ndarray:
    """Sorted numbers of the n-grams present: code points plus one, 21 bits each."""
    found = []
    text = text.lower()
    for at in range(0, max(len(text), 1), _PIECE):
        part = text[at : at + _PIECE + max(ORDERS) - 1]
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        grams, code = [], np.zeros(len(points), np.int64)
        for n in range(1, max(ORDERS) + 1):
            code = points if n == 1 else (code[:-1] << 21) | points[n - 1 :]
            if n in ORDERS:
                grams.append(code)
        grams = np.concatenate(grams)
        grams.sort()
        found.append(grams[np.r_[True, grams[1:] != grams[:-1]]] if len(grams) else grams)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Model:
    """languages; grams, the landmarks' n-grams in order; presence, n-grams by landmarks; norms of the landmarks; weights, landmarks by languages."""

    languages: list[str]
    grams: np.ndarray
    presence: np.ndarray
    norms: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(texts), len(self.grams)), np.float32)
        for row, grams in zip(rows, texts):
            at = np.searchsorted(self.grams, grams)
            at[at == len(self.grams)] = 0
            row[at[self.grams[at] == grams]] = 1
        sizes = np.sqrt([max(1, len(g)) for g in texts])
        return (rows @ self.presence).astype(np.float64) / sizes[:, None] / self.norms

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        values = self.kernel([ngrams(t) for t in texts]) @ self.weights
        best = values.argmax(1)
        return [(self.languages[b], float(np.clip((v[b] + 1) / 2, 0, 1))) for b, v in zip(best, values)]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from (text, language) rows in the order of the sample; None if there are none."""
    return fit_grams([(ngrams(t), l) for t, l in rows if t and any(map(str.isalpha, t))], landmarks, ridge)


def fit_grams(rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from (n-grams, language) rows in the order of the sample; None if there are none."""
    if not rows:
        return None
    languages = sorted({l for _, l in rows})
    grams = [g for g, _ in rows]
    # landmarks in turn from each language
    turns = {l: iter([k for k, r in enumerate(rows) if r[1] == l]) for l in languages}
    chosen: list[int] = []
    while len(chosen) < min(landmarks, len(rows)):
        for l in languages:
            if (k := next(turns[l], None)) is not None and len(chosen) < landmarks:
                chosen.append(k)
    vocabulary, held_by = np.unique(np.concatenate([grams[k] for k in chosen]), return_counts=True)
    if len(vocabulary) > VOCABULARY:  # those in most landmarks, then by a hash
        keep = np.lexsort((vocabulary.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), -held_by))[:VOCABULARY]
        vocabulary = np.sort(vocabulary[keep])
    presence = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for column, k in enumerate(chosen):
        presence[np.isin(vocabulary, grams[k], assume_unique=True), column] = 1
    norms = np.sqrt([len(grams[k]) for k in chosen])
    model = Model(languages, vocabulary, presence, norms, np.zeros((len(chosen), len(languages))))
    among = model.kernel([grams[k] for k in chosen])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([model.kernel(grams[k : k + BATCH]) for k in range(0, len(rows), BATCH)]) @ root
    target = np.where(np.array([r[1] for r in rows])[:, None] == np.array(languages), 1.0, -1.0)
    # languages count alike, whatever their share of the sample
    own = np.array([1 / sum(r[1] == l for r in rows) for l in languages])
    importance = own[(target > 0).argmax(1)][:, None]
    left = features.T @ (features * importance) + ridge * np.eye(features.shape[1]) / len(rows)
    model.weights = root @ np.linalg.solve(left, features.T @ (target * importance))
    return model


def thinned(grams: np.ndarray, most: int = GRAMS) -> np.ndarray:
    """Of many n-grams those with the smallest hashes, the same ones in every text."""
    if len(grams) <= most:
        return grams
    mixed = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(grams[np.argpartition(mixed ^ (mixed >> np.uint64(32)), most)[:most]])


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> list[tuple[np.ndarray, str]]:
    """N-grams and language of about per_language rows of each language, by the hash of the id: a share of each that follows from its count."""
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the counts are a written table, so that Spark knows their size and sends them along if they are few
    counts = common.cut(known.groupBy(F.col(lang).alias("__l")).agg(F.count("*").alias("__n")))
    share = F.lit(float(max(1, min(per_language, ROWS // max(1, counts.count())))))

    @F.pandas_udf("binary")
    def present(texts):
        import pandas as pd

        return pd.Series([thinned(ngrams(t)).tobytes() if any(map(str.isalpha, t)) else None for t in texts], dtype=object)

    drawn = known.join(counts, F.col(lang) == F.col("__l")).where(draw < share / F.col("__n")).select(F.col(text).alias("t"), F.col(lang).alias("l"), draw.alias("d"))
    picked = drawn.select(present.asNondeterministic()("t").alias("g"), "l", "d").where("g IS NOT NULL").collect()
    picked.sort(key=lambda r: (r["d"], r["l"], r["g"]))
    return [(np.frombuffer(r["g"], np.int64), r["l"]) for r in picked]


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    score = scorer(docs.sparkSession, model)
    return slim.select("doc_id", score(F.col("text")).alias("p")).select("doc_id", F.col("p.lang_pred"), F.col("p.score"))


def scorer(spark: SparkSession, model: Model | None):
    """A column function from text to struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts):
        import pandas as pd

        model, out = shared.value, [(UNKNOWN, 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if model is not None and t is not None and any(map(str.isalpha, t))]
        for at in range(0, len(known), BATCH):
            part = known[at : at + BATCH]
            for k, found in zip(part, model.predict([texts.iloc[k] for k in part])):
                out[k] = found
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    # else the optimizer may evaluate it anew for each use
    return predicted.asNondeterministic()


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def learnt(docs: DataFrame) -> Model | None:
    """The model of the documents whose crc32(doc_id) mod 4 is not 2."""
    return fit_grams(training_rows(docs.where(~held_out("doc_id")), "doc_id", "text", "lang"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that are text of a known language, a language that was missing filled in; all texts with a letter when none could be learnt."""
    model = learnt(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("__p", scorer(docs.sparkSession, model)(F.col("text")))
    kept = found.where(F.col("__p.lang_pred") != UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "__p.lang_pred")).select(docs.columns)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = scorer(spark, learnt(docs))
    found = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), score(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang_pred"), F.col("p.score"))
