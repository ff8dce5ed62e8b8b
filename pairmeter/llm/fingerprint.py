"""Document fingerprints by a randomised edit embedding.

A text is walked by a shared random walk: at step j the walk reads the character under it, and a random
bit fixed by (j, character) decides whether it moves on. Two texts a few edits apart fall back into step
soon, so their sequences of characters read differ in few places: edit distance becomes Hamming
distance. The fingerprint keeps four hashed bits of every so-many-th step, as one hexadecimal digit.
Long texts are walked in blocks of ``BLOCK`` characters, all blocks of a batch in step; the walk covers
the whole text, and a fingerprint grows with it.

Likeness is the share of sampled steps that agree. It is a lower bound in spirit: walks that an edit has
thrown out of step take a random time to fall back, so a text with one edit scores between the edit's
place and 1, while unrelated texts stay near a seventh. Near-duplicates are found by bands of successive
samples: documents that share a band are compared with its smallest document and linked if the
fingerprints are alike enough.

Defined cases: a null text is empty and has an empty fingerprint, which is like another empty one (1)
and unlike any other (0); documents with equal or null doc_id are neighbours in order of their texts,
nulls last; a lone document is its own neighbour; an empty table gives no rows; extra columns are
ignored.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.llm.common import components, partitions, read, stage

BLOCK, SAMPLES, PERIOD = 4096, 128, 4096
BAND, LIKE = 6, 0.6
_rng = np.random.default_rng(20231)
_MOVES = _rng.integers(0, 2, (PERIOD, 256), dtype=np.int64)
_DIGITS = _rng.integers(0, 16, (PERIOD, 256), dtype=np.uint8)
_PAD = 16
_HEX = np.frombuffer(b"0123456789abcdef-", np.uint8)


def _levels(lengths: np.ndarray) -> np.ndarray:
    """Every 2**level-th step is sampled, so that three steps per character fit into the samples."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(lengths, 1) * 3 / SAMPLES))).astype(np.int64)


def embed(texts):
    """(digits of every block, level of every block, number of blocks of every text)."""
    codes = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    n_blocks = -(-sizes // BLOCK)
    flat = np.concatenate([*codes, np.zeros(128, np.uint32)])
    symbol = ((flat ^ (flat >> np.uint32(8)) * np.uint32(31)) & np.uint32(255)).astype(np.int64)
    nth = np.arange(int(n_blocks.sum())) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + nth * BLOCK
    length = np.minimum(np.repeat(sizes, n_blocks) - nth * BLOCK, BLOCK)
    level = _levels(length)
    out = np.full((len(start), SAMPLES), _PAD, np.uint8)
    order = np.argsort(-length, kind="stable")
    who, pos, end, lvl, last = order, start[order], (start + length)[order], level[order], 3 * length[order]
    j, top = 0, int(level.max()) if len(level) else 0
    while len(who):
        for _ in range(64):
            read_now = symbol[pos]
            turn = j & -j if j else 1 << top
            first = np.searchsorted(-lvl, -(turn.bit_length() - 1))
            if first < len(who):
                s = slice(first, None)
                live = (pos[s] < end[s]) & (j < last[s])
                out[who[s][live], j >> lvl[s][live]] = _DIGITS[j % PERIOD, read_now[s][live]]
            pos = pos + _MOVES[j % PERIOD, read_now]
            j += 1
        live = (pos < end) & (j < last)
        if not live.all():
            who, pos, end, lvl, last = who[live], pos[live], end[live], lvl[live], last[live]
    return out, level, n_blocks


def fingerprints(texts) -> list:
    """Blocks as a letter for the level and the sampled digits, joined by full stops; "" for an empty text."""
    digits, level, n_blocks = embed(texts)
    chars = _HEX[digits]
    blocks = [chr(97 + v) + c.tobytes().decode().rstrip("-") for v, c in zip(level, chars)]
    ends = np.cumsum(n_blocks)
    return [".".join(blocks[e - n:e]) for n, e in zip(n_blocks, ends)]


def _coarse(block: str, level: int) -> np.ndarray:
    return np.frombuffer(block[1::1 << (level - ord(block[0]) + 97)].encode(), np.uint8)


def likeness(a: str, b: str) -> float:
    """Agreeing samples as a share of the samples that either fingerprint has."""
    if a == b:
        return 1.0
    same = total = 0
    x, y = a.split(".") if a else [], b.split(".") if b else []
    for p, q in zip(x, y):
        level = max(ord(p[0]), ord(q[0])) - 97
        u, v = _coarse(p, level), _coarse(q, level)
        k = min(len(u), len(v))
        same += int(np.count_nonzero(u[:k] == v[:k]))
        total += max(len(u), len(v))
    longer = x if len(x) > len(y) else y
    total += sum(len(p) - 1 for p in longer[min(len(x), len(y)):])
    return same / total if total else 0.0


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, text), sorted inside partitions so that every document with ``tail`` 0 is
    followed by its successor in descending doc_id, the last one by the first.

    Documents are dealt to buckets of neighbouring ids; the first document of a bucket is sent to the
    bucket above too. Bucket bounds are quantiles of the ids; the texts are shuffled once.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions(docs.sparkSession)
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(doc_id: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, doc_id.fillna(0).to_numpy(np.int64), side="right") + 1
        return pd.Series(np.where(doc_id.isna(), 0, at)).astype("int32")

    heads = d.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))
    heads = sorted(heads.collect(), reverse=True)  # one row per bucket
    if not heads:
        return d.select(F.lit(0).alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text")
    above = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}
    # the ids that start a bucket are one per bucket: a lookup in a literal map
    known = [x for h, b in above.items() if h is not None for x in (F.lit(h).cast("long"), F.lit(b).cast("int"))]
    to = F.try_element_at(F.create_map(*known), F.col("doc_id")) if known else F.lit(None).cast("int")
    to = F.when(F.col("doc_id").isNull(), F.lit(above.get(None)).cast("int")).otherwise(to)
    own = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("tail"))
    rows = d.withColumn("own", bucket("doc_id")).withColumn("to", to)
    copies = F.when(F.col("to").isNotNull(), F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.explode(copies).alias("p")).select("p.bucket", "p.tail", "doc_id", "text")
    return (rows.repartition(partitions(docs.sparkSession), "bucket")
                .sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text"))


def describe(docs: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """One row per document: its fingerprint, that of the edited text, and likenesses."""
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(rows, following):
        texts = [r[3] for r in rows]
        after = [r[3] for r in following]
        edited = [t[:len(t) - len(t) // 2] + s[:len(t) // 2] for t, s in zip(texts, after)]
        prints = fingerprints([*texts, after[-1], *edited])
        n = len(rows)
        own, last, new = prints[:n], prints[n], prints[n + 1:]
        following_prints = [*own[1:], last]
        # a successor is the next row, except at the end of a bucket's own rows
        for k in range(n - 1):
            if following[k] is not rows[k + 1]:
                following_prints[k] = fingerprints([after[k]])[0]
        out = pd.DataFrame({"doc_id": pd.array([r[2] for r in rows], dtype="Int64"), "n_chars": [len(t) for t in texts],
                            "edited_sha256": [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], "fingerprint": own, "edited_fingerprint": new,
                            "near_edited": [likeness(a, b) for a, b in zip(own, new)], "near_next": [likeness(a, b) for a, b in zip(own, following_prints)]})
        return out[columns]

    def scan(frames):
        rows, following, size, last = [], [], 0, None
        for f in frames:
            for row in zip(f["bucket"], f["tail"], [None if pd.isna(x) else int(x) for x in f["doc_id"]], f["text"]):
                if last is not None and last[1] == 0 and last[0] == row[0]:
                    rows.append(last)
                    following.append(row)
                    size += len(last[3]) + 1
                    if size >= limit:
                        yield work(rows, following)
                        rows, following, size = [], [], 0
                last = row
        if rows:
            yield work(rows, following)

    return in_order(docs).mapInPandas(scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                            "near_edited double, near_next double")


def bands(fingerprint: str) -> list:
    """Keys of successive samples, at the block's own level and the next coarser one."""
    out = []
    for k, block in enumerate(fingerprint.split(".") if fingerprint else []):
        level = ord(block[0]) - 97
        for v in (level, level + 1):
            digits = _coarse(block, v).tobytes().decode()
            out += [f"{k}:{v}:{i}:{digits[i:i + BAND]}" for i in range(0, len(digits) - BAND + 1, BAND)] or [f"{k}:{v}::{digits}"]
    return out


def near_duplicates(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """(doc_id, component_id): documents linked by bands and verified likeness; equal texts from the start."""
    def scan(frames):
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at:at + 512]
                yield pd.DataFrame({"doc_id": g["doc_id"].astype("Int64"), "fingerprint": fingerprints(g["text"].tolist())})

    @F.pandas_udf("array<string>")
    def keys(fp: pd.Series) -> pd.Series:
        return fp.map(bands)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(d.mapInPandas(scan, "doc_id long, fingerprint string"))
    units = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low_id")).withColumn("unit", F.monotonically_increasing_id()))
    each = stage(units.where("fingerprint <> ''").select("unit", F.explode(keys("fingerprint")).alias("key")))
    hubs = each.groupBy("key").agg(F.min("unit").alias("hub"), F.max("unit").alias("other")).where("hub < other")
    pairs = each.join(hubs, "key").where("unit <> hub").select("unit", "hub").distinct()
    text = units.select("unit", "fingerprint")
    judged = (pairs.join(text, "unit").join(text.select(F.col("unit").alias("hub"), F.col("fingerprint").alias("other")), "hub")
                   .where(alike("fingerprint", "other") >= least))
    node = components(judged.select(F.col("unit").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "unit")
    named = units.join(node, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    low = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    found = stage(named.join(low, "component").select("fingerprint", "component_id"))
    return rows.join(found, "fingerprint").select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(read(spark, sf_dir, "documents"))
