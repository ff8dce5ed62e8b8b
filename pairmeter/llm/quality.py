"""A quality classifier: random Fourier features, ridge from summed normal equations, isotonic scores.

A document becomes a few statistics of its whole text (character classes, word and line shape,
repetition). Random Fourier features approximate a Gaussian kernel over the standardised statistics;
ridge regression on them needs only the sums Z'Z and Z'y, which every partition of the labelled rows
adds up. A fifth of those rows is left out of the sums and calibrates the raw scores by isotonic
regression over score bins.

Statistics are computed once and written; texts are never shuffled. Labels are learned from at most
``LABELLED`` rows in expectation, chosen by hash.

Defined cases: a null or empty text has the statistics of an empty text and is scored like any other;
several labels of a document all count; a null label or doc_id is not learned from; with no usable label
every score is 0.5; rows are scored one by one; an empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.llm.common import _SPACE, batches_by_bytes, md5_int, read, stage, text_buffer, word_hashes

FOURIER, RIDGE, LABELLED, SUMS, BINS = 256, 1.0, 200_000, 16, 1000
STATISTICS = ["log_bytes", "log_words", "upper", "lower", "digit", "space", "mark", "pipe", "bang", "symbol", "beyond_ascii", "word_mean",
              "word_spread", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "lines_per_word", "distinct_lines", "short_words"]


def _classes() -> np.ndarray:
    c = np.full(256, 6)
    c[65:91], c[97:123], c[48:58], c[_SPACE], c[128:] = 0, 1, 2, 3, 4
    for k, chars in ((5, "|"), (7, "!?"), (8, "#$%&*@^~<>{}[]\\=+_")):
        c[[ord(x) for x in chars]] = k
    return c


_CLASS = _classes()


def _distinct(row, value, n):
    """(number of distinct values, count of the commonest) in every row."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]) if len(r) else np.zeros(0, bool)
    runs = np.diff(np.append(np.flatnonzero(new), len(r)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[new], runs)
    return np.bincount(r[new], minlength=n), most


def statistics(texts) -> np.ndarray:
    buf, starts = text_buffer(texts)
    n, size = len(starts) - 1, np.diff(starts) - 1
    kinds = np.zeros((n, 9))
    for lo in range(0, len(buf), 1 << 20):
        part = buf[lo:lo + (1 << 20)]
        row = np.searchsorted(starts, np.arange(lo, lo + len(part)), side="right") - 1
        kinds += np.bincount(row * 9 + _CLASS[part], minlength=n * 9).reshape(n, 9)
    kinds[:, 3] -= 1  # the line feed after every text
    h, first = word_hashes(buf)
    row = np.searchsorted(starts, first, side="right") - 1
    words = np.bincount(row, minlength=n)
    space = np.flatnonzero(_SPACE[buf])
    length = space[np.searchsorted(space, first)] - first
    per = 1 / np.maximum(words, 1)
    mean = np.bincount(row, length, minlength=n) * per
    spread = np.sqrt(np.maximum(np.bincount(row, length.astype(float) ** 2, minlength=n) * per - mean**2, 0))
    kinds_of, most = _distinct(row, h, n)
    next_in = row[1:] == row[:-1]
    same = np.bincount(row[1:][next_in & (h[1:] == h[:-1])], minlength=n)
    pairs, _ = _distinct(row[1:][next_in], (h[1:] * np.uint64(3) + h[:-1])[next_in], n)
    short = np.bincount(row[length <= 3], minlength=n)
    # a line is the sum of its words' hashes, each turned by its place
    ends = np.flatnonzero(buf == 10)
    line = np.searchsorted(ends, first)
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = (np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))).astype(np.uint64)
    sums = np.add.reduceat(h * (place * np.uint64(2) + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
    lines = np.bincount(row[new], minlength=n)
    line_kinds, _ = _distinct(row[new], sums, n)
    share = kinds[:, [0, 1, 2, 3, 6, 5, 7, 8, 4]] / np.maximum(size, 1)[:, None]
    return np.column_stack([np.log1p(size), np.log1p(words), share, mean, spread, kinds_of * per, most * per, same * per,
                            (pairs + 1) / np.maximum(words, 1), lines * per, line_kinds / np.maximum(lines, 1), short * per])


def document_statistics(docs: DataFrame) -> DataFrame:
    def scan(frames):
        for f in frames:
            for g in batches_by_bytes([f], "text"):
                yield pd.DataFrame({"doc_id": g["doc_id"].astype("Int64").to_numpy(), "stats": list(statistics(g["text"].tolist()))}).astype({"doc_id": "Int64"})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stage(d.mapInPandas(scan, "doc_id long, stats array<double>"))


class Fourier:
    def __init__(self, mean, std, n: int = FOURIER, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.standard_normal((len(mean), n)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, stats):
        x = np.clip((np.stack(stats) - self.mean) / self.std, -6, 6)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)])


def isotonic(x, y, weight):
    """Non-decreasing fit by pooling adjacent violators: block centres and values."""
    blocks = []
    for a, b, w in sorted(zip(x, y, weight)):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame):
    """A function from statistics to scores, learned from ``labelled(doc_id, stats, quality)``."""
    n = labelled.count()
    rank = md5_int(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")))
    rows = labelled.withColumn("rank", rank).where(F.col("rank") / F.lit(float(1 << 60)) * n < LABELLED)
    rows = stage(rows.select("stats", F.col("quality").cast("double").alias("y"), (F.col("rank") % 5 == 0).alias("calibrates"),
                             F.pmod(F.shiftright("rank", 20), F.lit(SUMS)).alias("part")))
    k = len(STATISTICS)
    moments = rows.where(~F.col("calibrates")).agg(F.count("*"), *[f(F.col("stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return lambda stats: np.full(len(stats), 0.5)
    z = Fourier(np.array(moments[1::2], float), np.array(moments[2::2], float))

    def sums(pdf):
        m, y = z(pdf["stats"]), pdf["y"].to_numpy()
        return pd.DataFrame({"zz": [(m.T @ m).ravel().tobytes()], "zy": [(m.T @ y).tobytes()]})

    parts = rows.where(~F.col("calibrates")).groupBy("part").applyInPandas(sums, "zz binary, zy binary").collect()  # SUMS rows at most
    zz, zy = (np.sum([np.frombuffer(p[i]) for p in parts], axis=0) for i in (0, 1))
    penalty = np.full(len(zy), RIDGE)
    penalty[0] = 1e-9
    beta = np.linalg.solve(zz.reshape(len(zy), -1) + np.diag(penalty), zy)

    def binned(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"bin": np.clip(np.rint(z(f["stats"]) @ beta * BINS), -BINS, 2 * BINS).astype(np.int64), "y": f["y"]})

    bins = rows.where("calibrates").mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).toPandas()
    if not len(bins):
        return lambda stats: np.clip(z(stats) @ beta, 0, 1)
    x, y = isotonic(bins["bin"] / BINS, bins["y"], bins["n"])

    def score(stats):
        raw = z(stats) @ beta
        # steps joined by lines; beyond them the raw score still orders the documents, within one step
        lean = 0.02 * (np.clip(raw, -1, 2) + 1) / 3 - 0.01
        return np.clip(np.interp(raw, x, y) * 0.98 + 0.01 + lean, 0, 1)
    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, learned from the rows not held out."""
    stats = document_statistics(docs)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    score = fit(stats.where(~held).join(known, "doc_id").select("doc_id", "stats", "quality"))

    def apply(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "held_out": f["held_out"].to_numpy(), "score": score(f["stats"])}).astype({"doc_id": "Int64"})

    out = stats.select("doc_id", held.alias("held_out"), "stats").mapInPandas(apply, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
