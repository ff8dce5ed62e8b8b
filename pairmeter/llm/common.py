"""Helpers shared by the corpus operators: reading, row ranks, connected components, text hashing."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairmeter.plans.local import constant_table
from pairmeter.plans.staging import stage

#: Everything but the space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_int(value: Column) -> Column:
    """60 bits of the MD5 of a string, as a non-negative long that other SQL engines can repeat."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the filters over ids that spare most rows a shuffle; a full filter spares none.
FILTER = 1 << 20


def id_filter(ids: DataFrame) -> bytes:
    """A filter of fixed size over the ids in ``ids(id)``; a null id counts as 0."""
    bits = np.zeros(FILTER, dtype=bool)
    hit = ids.select(F.pmod(F.coalesce("id", F.lit(0)), F.lit(FILTER)).alias("i")).distinct().toPandas()["i"]
    bits[hit.to_numpy(dtype=np.int64)] = True
    return np.packbits(bits).tobytes()


def give_back() -> None:
    """Returns freed memory to the system. A Python worker lives on after a task, and what it once needed
    would count against the tasks of other stages."""
    import ctypes
    import gc

    import pyarrow
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_row(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that columns added by an operator cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rows with their global position under ``order`` (column expressions), counted from 0.

    A range shuffle and a sort inside each partition; only one row count per partition reaches the
    driver. The sorted rows are written first, so that positions cannot change when a task runs again.
    """
    spark = df.sparkSession
    rows = stage(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                   .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())
    offsets = np.concatenate([[0], np.cumsum([c for _, c in counts])[:-1]]) if counts else np.zeros(0)
    table = constant_table(spark, {"_part": np.array([p for p, _ in counts], dtype=np.int64),
                                   "_before": offsets.astype(np.int64)})
    return (rows.withColumn("_part", part).join(table, "_part")
                .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
                .drop("_part", "_before", "_at"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: component is the smallest node reachable.

    Alternating large-star and small-star rounds. A round is one minimum per node, combined on the map
    side, and one join; links already known are pointed at a smaller node, so the links never grow
    beyond their first number and a node with very many links is only a skewed join side. Every round
    is written to the shared folder, which cuts the lineage.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("x"), F.col("m"))
                      .unionByName(low.select(F.col("u").alias("x"), "m")).where("x <> m")
                      .select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        links = stage(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = links.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def text_buffer(texts):
    """One UTF-8 byte array of all texts (null: empty), each ended by a line feed, and the text starts."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8), starts


def batches_by_bytes(frames, column: str, limit: int = 1 << 20):
    """Slices of the incoming frames whose texts hold about ``limit`` characters, one row at least."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges], [*edges, len(frame)]):
            if b > a:
                yield frame.iloc[a:b]


# ---- hashed words and shingles ---------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = _STEP
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, segment: int = 1 << 20):
    """(64-bit hash, first byte) of every word in a byte array; A to Z count as lower case.

    Works in segments cut at white space, so the memory used does not follow the length of a text.
    """
    hashes, firsts, at = [], [], 0
    while at < len(buf):
        stop = min(at + segment, len(buf))
        while stop < len(buf) and not _SPACE[buf[stop - 1]]:
            gap = np.flatnonzero(_SPACE[buf[stop:stop + segment]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + segment, len(buf))
        part = buf[at:stop]
        space = _SPACE[part]
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(first):
            length = np.diff(np.append(first, len(part)))
            place = np.arange(first[0], len(part)) - np.repeat(first, length)
            value = _BYTE[_LOWER[part[first[0]:]]] * _powers(int(length.max()))[place]
            value[space[first[0]:]] = 0
            hashes.append(mix64(np.add.reduceat(value, first - first[0])))
            firsts.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts, width: int):
    """The sorted distinct ``width``-word shingles of every text as 63-bit hashes; a shorter text is one
    shingle, a text without words has none."""
    buf, starts = text_buffer(texts)
    h, first = word_hashes(buf)
    bound = np.searchsorted(first, starts)
    factor = mix64(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    s = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        s += h[k:k + len(s)] * factor[k]
    s = (mix64(s) >> np.uint64(1)).astype(np.int64)
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a >= width:
            yield np.unique(s[a:b - width + 1])
        elif b > a:
            whole = np.sum(h[a:b] * factor[:b - a], keepdims=True) + np.array([b - a], np.uint64) * _STEP
            yield (mix64(whole) >> np.uint64(1)).astype(np.int64)
        else:
            yield np.zeros(0, np.int64)
