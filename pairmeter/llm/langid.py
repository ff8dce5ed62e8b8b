"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character 1- to 3-grams around letters, in lower case.
Every language is described by several centroids, found by spherical k-means on a bounded sample of its
labelled documents; a text gets the language of the centroid at the largest cosine, over the whole text.
A text farther from that centroid than its members can be explained by is rejected.

The sample is ``PER_LANGUAGE`` documents per language in expectation, chosen by hash; the fit of one
language is one task. Nothing else is bounded by a number of rows.

Defined cases: a null text and one without a letter is ``und`` with score 0 and rejected; a null doc_id
is never learned from and not held out; languages are learned only from non-null labels; without any
labelled text every text is ``und``; ties go to the language first in order; rows are judged one by one;
an empty table gives no rows; extra columns are ignored by ``predict`` and kept by ``keep_known``.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairmeter.llm.common import md5_int, mix64, read, stage

FEATURES, CENTROIDS, PER_LANGUAGE, ROUNDS = 4096, 4, 1000, 12
SHARPNESS, UNKNOWN = 25.0, "und"
#: Texts vectorised at once.
BATCH = 64
_LETTERS = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0][codes]


def ngram_counts(texts, features: int = FEATURES, segment: int = 1 << 20) -> np.ndarray:
    """Rows of n-gram counts of every text; a row without a letter is zero."""
    out = np.zeros((len(texts), features), np.float64)
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    bounds = np.cumsum([0] + [len(c) + 3 for c in codes])  # a space before each text, two after it
    gap = np.full(2, 32, np.uint32)
    flat = np.concatenate([x for c in codes for x in (gap[:1], c, gap)] + [gap]) if codes else gap
    for lo in range(0, int(bounds[-1]), segment):
        hi = min(lo + segment, int(bounds[-1]))
        part = flat[lo:hi + 2]
        letter = _is_letter(part)
        c = np.where(letter, part, 32).astype(np.uint64)
        a, b, d = c[:-2], c[1:-1], c[2:]
        row = np.searchsorted(bounds, np.arange(lo, hi), side="right") - 1
        own = np.arange(lo, hi) < bounds[row + 1] - 2  # no n-gram reaches into the next text
        grams = ((letter[:-2], a * np.uint64(0x9E3779B97F4A7C15)),
                 (letter[:-2] | letter[1:-1], a * np.uint64(0xC2B2AE3D27D4EB4F) + b * np.uint64(0x165667B19E3779F9)),
                 (letter[1:-1], a * np.uint64(0x27D4EB2F165667C5) + b * np.uint64(0x85EBCA77C2B2AE63) + d * np.uint64(0xD6E8FEB86659FD93)))
        first, last = int(row[0]), int(row[-1]) + 1
        for use, h in grams:
            use = use & own
            at = (row[use] - first) * features + (mix64(h[use]) % np.uint64(features)).astype(np.int64)
            out[first:last] += np.bincount(at, minlength=(last - first) * features).reshape(-1, features)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centroids(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3):
    """Spherical k-means of unit rows: (centroids, largest member distance of each)."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):  # the row farthest from all centroids so far
        c = np.vstack([c, x[[int(np.argmin((x @ c.T).max(1)))]]])
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[nearest == i].sum(0) if (nearest == i).any() else c[i] for i in range(len(c))]))
    sims = x @ c.T
    nearest = sims.argmax(1)
    far = 1 - np.array([np.quantile(sims[nearest == i, i], 0.002) if (nearest == i).any() else 1.0 for i in range(len(c))])
    return c, far


def training(docs: DataFrame) -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, features: int = FEATURES) -> dict:
    """The model from ``labelled(doc_id, text, lang)``: languages, centroids, limits and IDF weights."""
    # one number per language: a lookup, so that no text is shuffled for the sample
    sizes = sorted((r.lang, r.n) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())
    n = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes for x in pair]), F.col("lang")) if sizes else F.lit(0)
    share = md5_int(F.concat(F.lit("langid:"), F.col("doc_id").cast("string"))) / F.lit(float(1 << 60))
    sample = labelled.where(share * n < per_language).select("lang", "text")

    def vectors(frames):
        for f in frames:
            for at in range(0, len(f), BATCH):
                part = f.iloc[at:at + BATCH]
                x = ngram_counts(part["text"].tolist(), features)
                some = x.any(1)
                yield pd.DataFrame({"lang": part["lang"].to_numpy()[some], "x": [r.astype(np.float32).tobytes() for r in x[some]]})

    rows = stage(sample.mapInPandas(vectors, "lang string, x binary"))

    def frequencies(pdf):
        x = np.stack([np.frombuffer(b, np.float32) for b in pdf["x"]])
        return pd.DataFrame({"n": [len(x)], "df": [(x > 0).sum(0).astype(np.int64).tolist()]})

    seen = rows.groupBy("lang").applyInPandas(frequencies, "n long, df array<long>").toPandas()
    if not len(seen):
        return {"langs": np.array([], dtype=object), "c": np.zeros((0, features), np.float32), "limit": np.zeros(0), "idf": np.ones(features)}
    idf = np.log((1 + seen["n"].sum()) / (1 + np.sum(np.stack(seen["df"]), axis=0))) + 1

    def cluster(key, pdf):
        c, far = centroids(_unit(np.stack([np.frombuffer(b, np.float32) for b in pdf["x"]]) * idf))
        return pd.DataFrame({"lang": key[0], "c": [r.astype(np.float32).tobytes() for r in c], "far": far})

    found = rows.groupBy("lang").applyInPandas(cluster, "lang string, c binary, far double").toPandas().sort_values(["lang", "far"], kind="stable")
    return {"langs": found["lang"].to_numpy(), "c": np.stack([np.frombuffer(b, np.float32) for b in found["c"]]),
            # members lie within ``far``; an unseen text of the language may lie a third of the rest further
            "limit": found["far"].to_numpy() * 2 / 3 + 1 / 3, "idf": idf}


def classify(texts, model: dict) -> pd.DataFrame:
    x = ngram_counts(texts, len(model["idf"]))
    some = x.any(1) & bool(len(model["langs"]))
    names = np.unique(model["langs"].astype(str)) if len(model["langs"]) else np.array([UNKNOWN])
    lang, score, rejected = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x)), np.ones(len(x), dtype=bool)
    if some.any():
        sims = _unit(x[some] * model["idf"]) @ model["c"].T
        best = np.stack([sims[:, model["langs"] == n].max(1) for n in names], axis=1)
        e = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        lang[some], score[some] = names[best.argmax(1)], e.max(1) / e.sum(1)
        at = sims.argmax(1)
        rejected[some] = 1 - sims[np.arange(len(at)), at] > model["limit"][at]
    return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "rejected": rejected})


def predictor(model: dict):
    """A column function from text to (lang_pred, score, rejected)."""
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(schema)
    def predict(text: pd.Series) -> pd.DataFrame:
        t = text.tolist()
        parts = [classify(t[i:i + BATCH], model) for i in range(0, len(t), BATCH)]
        return pd.concat(parts, ignore_index=True) if parts else classify([], model)

    return predict.asNondeterministic()  # evaluated once, also below a filter


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) with a model learned from the rows not held out."""
    model = fit(docs.where(training(docs)).select("doc_id", "text", "lang"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predictor(model)(F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    model = fit(docs.where(training(docs)).select("doc_id", "text", "lang"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predictor(model)(F.col("text")).alias("p"))
    return rows.where(~F.col("p.rejected")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(read(spark, sf_dir, "documents"))
