"""Near-duplicate documents by an n-gram Jaccard join with token-combination prefixes.

A document is its set of word shingles. All documents order shingles alike: first those in a fixed part
of the hash space by their number of documents, then the others by hash. Two sets at the threshold
differ in so few shingles that they must share some within a prefix. Rare shingles are index keys by
themselves. Frequent ones (more than ``FREQUENT`` documents) fall into classes by hash and are indexed as
2-combinations inside a class, for which the prefix is extended by one shingle per class: if a class
shared fewer than two, the pair would miss more shingles than the threshold allows.

Documents with a key in common form candidate groups. No pair is ever emitted: a key sends one row per
document to its smallest document, the groups are the connected components of those rows, and a group is
compared inside tasks, in tiles if it is large, on the whole sets. Every pair of the group that reaches
the threshold is linked there; a task returns spanning links only. Texts with equal sets are one unit
from the start. Sets are computed twice instead of being stored: once for keys, once for the documents
that are in a group.

Shingles are compared by 63-bit hashes. Defined cases: a null or empty text and one without words has
an empty set and links with nothing; a text of fewer words than a shingle is one shingle; rows that
repeat a doc_id are documents of their own; a null doc_id is kept and loses to any id; an empty table
gives no rows; extra columns are ignored by ``groups`` and kept by ``keep_one``.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from pairmeter.llm.common import FILTER, as_row, batches_by_bytes, components, give_back, id_filter, ranked, read, shingle_sets, stage, unstage

WORDS, PERCENT = 3, 90
FREQUENT = 32
SMALL_SET = 24
#: Units of a tile, and bytes of sets that one task compares.
TILE, PACK = 256, 8 << 20


def region_end(percent: int) -> int:
    """End of the hash space in which shingles are counted: the share that two sets may differ in, and a
    tenth more for shingles that are not rare."""
    return int((110 - percent) / 100 * 2**63)


def spare(n: int, percent: int) -> int:
    """Shingles of a set of n that a set at the threshold may lack."""
    return n - -(-percent * n // 100)


def classes(n: int, percent: int) -> list:
    """Numbers of frequent-shingle classes under which a set of n is indexed.

    They follow a ladder of sizes; a set near a rung is indexed on both sides of it, so two sets at the
    threshold always have one number in common.
    """
    rungs = set()
    for size in (n * percent // 100, n, -(-n * 100 // percent)):
        rung = 1
        while rung * 1.5 <= size:
            rung *= 1.5
        rungs.add(0 if rung <= SMALL_SET else max(1, round(rung * (100 - percent) / 400)))
    return sorted(rungs)


def _scan(words: int, percent: int):
    end = region_end(percent)

    def scan(frames):
        for f in batches_by_bytes(frames, "text"):
            n, key, region, low = [], [], [], []
            for s in shingle_sets(f["text"], words):
                inside = int(np.searchsorted(s, end))
                need = spare(len(s), percent) + 1 + (max(classes(len(s), percent)) if len(s) else 0)
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest())
                region.append(inside)
                low.append(s[:max(inside, need)])
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "row_key": f["row_key"].to_numpy(), "n": n, "set_key": key, "region": region,
                                "low": low}).astype({"doc_id": "Int64"})
        give_back()
    return scan


def _keys(percent: int):
    def keys(frames):
        for f in frames:
            out = []
            for n, region, low, shared in zip(f["n"], f["region"], f["low"], f["shared"]):
                got = index_keys(n, region, low, [] if shared is None else [(x["count"], x["token"]) for x in shared], percent)
                out.append(np.array(got, np.uint64).view(np.int64))
            yield pd.DataFrame({"unit": f["unit"].to_numpy(), "keys": pd.Series(out, dtype=object)})
    return keys


def index_keys(n: int, region: int, low, shared: list, percent: int = PERCENT) -> list:
    """Index keys of a set of n shingles, ``region`` of them in the counted part of the hash space.

    ``shared`` holds (documents, shingle) for those of them that another document has too; the others
    come first in the order and need no key. ``low`` is the set's sorted beginning.
    """
    need = spare(n, percent) + 1 - (region - len(shared))
    if need <= 0:
        return []
    order = sorted(shared) + [(0, int(x)) for x in low[region:]]
    out = set()
    for m in classes(n, percent):
        got, byclass = 0, {}
        for count, token in order:
            if m and count > FREQUENT:
                mates = byclass.setdefault(token % m, [])
                got += bool(mates)
                mates.append(token)
            else:
                got += 1
                out.add(token)
            if got >= need:
                break
        for mates in byclass.values():
            for i, a in enumerate(mates):
                for b in mates[:i]:
                    out.add(((min(a, b) * 0x9E3779B97F4A7C15 + max(a, b) * 0xC2B2AE3D27D4EB4F + m) % 2**64) | 2**63)
    return sorted(out)


def _shared_counts(a: list, b: list) -> np.ndarray:
    """Sizes of the intersections of every set in ``a`` with every set in ``b``."""
    sets = a if b is a else a + b
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, who = (np.cumsum(often) - 1)[column[keep]], who[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(64, (8 << 20) // max(1, len(sets)))
    edges = np.searchsorted(column, np.arange(0, int(often.sum()) + width, width))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            m = np.zeros((len(sets), width), np.float32)
            m[who[lo:hi], column[lo:hi] % width] = 1
            out += m[:len(a)] @ (m if b is a else m[len(a):]).T
    return out.astype(np.int64)


def _spanning(n: int, i, j) -> np.ndarray:
    """The smallest member each of n items is linked with, over links (i, j)."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        if np.array_equal(m, low[i]) and np.array_equal(m, low[j]):
            break
        for at in (low[i], low[j], i, j):
            np.minimum.at(low, at, m)
        low = low[low]
    return low


def _linked(na, nb, both, percent: int):
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def _links(unit, low):
    moved = np.flatnonzero(low != np.arange(len(low)))
    return pd.DataFrame({"a": unit[moved], "b": unit[low[moved]]})


def _sets(column):
    return [np.frombuffer(x, dtype=np.int64) for x in column]


def _compare_groups(percent: int):
    def compare(pdf):
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})]
        for _, g in pdf.groupby("component"):
            g = g.drop_duplicates("unit")
            sets, n, unit = _sets(g["set"]), g["n"].to_numpy(), g["unit"].to_numpy()
            i, j = np.nonzero(np.triu(_linked(n, n, _shared_counts(sets, sets), percent), 1))
            out.append(_links(unit, _spanning(len(unit), i, j)))
            del sets
        give_back()
        return pd.concat(out)
    return compare


def _compare_tiles(percent: int):
    def compare(key, pdf):
        pdf = pdf.drop_duplicates("unit")
        if key[0] == key[1]:
            return _compare_groups(percent)(pdf.assign(component=0))
        left = pdf["tile"].to_numpy() == key[0]
        a, b = pdf[left], pdf[~left]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        i, j = np.nonzero(_linked(a["n"].to_numpy(), b["n"].to_numpy(), _shared_counts(_sets(a["set"]), _sets(b["set"])), percent))
        unit = np.concatenate([a["unit"].to_numpy(), b["unit"].to_numpy()])
        give_back()
        return _links(unit, _spanning(len(unit), i, j + len(a)))
    return compare


def _again(words: int, wanted: bytes):
    bits = np.unpackbits(np.frombuffer(wanted, dtype=np.uint8)).astype(bool)

    def again(frames):
        for f in frames:
            ids = f["doc_id"].fillna(0).to_numpy(dtype=np.int64)
            for g in batches_by_bytes([f[bits[ids % FILTER]]], "text"):
                sets = list(shingle_sets(g["text"], words))
                yield pd.DataFrame({"doc_id": g["doc_id"].to_numpy(), "set_key": [hashlib.md5(s.tobytes()).digest() for s in sets],
                                    "set": [s.tobytes() for s in sets]}).astype({"doc_id": "Int64"})
        give_back()
    return again


def row_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = stage(d.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))).mapInPandas(
        _scan(words, percent), "doc_id long, row_key string, n long, set_key binary, region int, low array<long>"))
    rows = stage(scanned.drop("region", "low"))
    wide = scanned.where("n > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("low_id"), F.first("n").alias("n"), F.first("region").alias("region"), F.first("low").alias("low"))
    wide = stage(wide.withColumn("unit", F.monotonically_increasing_id()))
    unstage(scanned)
    units = stage(wide.drop("region", "low"))

    tokens = wide.select("unit", F.explode(F.slice("low", F.lit(1), F.col("region"))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 1")
    shared = tokens.join(counts, "token").groupBy("unit").agg(F.collect_list(F.struct("count", "token")).alias("shared"))
    few = F.col("region") - F.coalesce(F.size("shared"), F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * percent / 100)
    keyed = wide.drop("set_key", "low_id").join(shared, "unit", "left").where(few)
    keysets = stage(keyed.mapInPandas(_keys(percent), "unit long, keys array<long>"))
    unstage(wide)
    keys = keysets.select("unit", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("unit").alias("hub"), F.max("unit").alias("other")).where("hub < other").drop("other")
    candidates = components(keys.join(hubs, "key").select(F.col("unit").alias("a"), F.col("hub").alias("b")))
    candidates = stage(candidates.withColumnRenamed("node", "unit").join(units.select("unit", "set_key", "low_id", "n"), "unit"))

    sets = d.mapInPandas(_again(words, id_filter(candidates.select(F.col("low_id").alias("id")))), "doc_id long, set_key binary, `set` binary").alias("s")
    c = candidates.alias("c")
    sized = candidates.groupBy("component").agg(F.count("*").alias("size"))
    members = sets.join(c, (F.col("s.set_key") == F.col("c.set_key")) & F.col("s.doc_id").eqNullSafe(F.col("c.low_id"))).select(
        "c.unit", "c.component", "c.n", "s.set")
    members = stage(members.join(sized, "component"))

    small = members.where(F.col("size") <= TILE)
    packs = max(1, -(-(small.agg(F.sum(F.length("set") + 64)).first()[0] or 0) // PACK))
    links = (small.groupBy(F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack"))
                  .applyInPandas(_compare_groups(percent), "a long, b long"))
    large = members.where(F.col("size") > TILE)
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, keysets, percent))
    node = components(stage(links)).withColumnRenamed("node", "unit")
    named = units.select("unit", "set_key", "low_id").join(node, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    low = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    found = stage(named.join(low, "component").select("set_key", "component_id", F.lit(True).alias("found")))
    return rows.join(found, "set_key", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def tile_keys(units: DataFrame) -> DataFrame:
    """(tile, key): the distinct keys of each tile of ``units(tile, keys)``."""
    own = units.groupBy("tile").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    return own.select("tile", F.explode("keys").alias("key"))


def _large_links(large: DataFrame, keysets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups of more than a tile: tiles in order of size; two tiles meet if a key occurs in
    both and their sizes allow a link. A tile names a key once, however many of its units have it. The keys
    of near copies occur in the same tiles, so the sets of tiles that have a key in common are few, and pairs
    are made of those."""
    placed = ranked(large.select("unit", "component", "n"), [F.col("component"), F.col("n"), F.col("unit")])
    start = placed.groupBy("component").agg(F.min("rank").alias("start"))
    tile = F.floor((F.col("rank") - F.col("start")) / TILE)
    placed = stage(placed.join(start, "component").select("unit", "n", F.concat_ws(":", "component", tile).alias("tile")))
    met = tile_keys(keysets.join(placed, "unit")).groupBy("key").agg(F.array_sort(F.collect_set("tile")).alias("tiles")).select("tiles").distinct()
    pairs = met.select("tiles", F.explode("tiles").alias("left")).select("left", F.explode("tiles").alias("right")).where("left <= right").distinct()
    spans = placed.groupBy("tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    pairs = pairs.join(a, F.col("left") == F.col("a.tile")).join(b, F.col("right") == F.col("b.tile")).where(near)
    pairs = stage(pairs.select("left", "right"))
    here = large.select("unit", "n", "set").join(placed.select("unit", "tile"), "unit")
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("left", "right"))))
    return here.join(sides, "tile").groupBy("left", "right").applyInPandas(_compare_tiles(percent), "a long, b long")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without the near-duplicates of a smaller doc_id; of equal rows one stays.

    Only rows that may have to go, by a filter of fixed size over the ids of those that do, are joined with
    the decision; all others pass where they are.
    """
    g = stage(groups(docs, words, percent).select("doc_id", "row_key", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("keep")))
    goes = g.groupBy("row_key").agg(F.first("doc_id").alias("id"), F.min("keep").alias("keep"), F.count("*").alias("n")).where("not keep or n > 1")
    bits = id_filter(goes.select("id").unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("id"))))

    @F.pandas_udf("boolean")
    def may_go(doc_id: pd.Series) -> pd.Series:
        known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        return pd.Series(known[doc_id.fillna(0).to_numpy(dtype=np.int64) % FILTER])

    marked = as_row(docs).withColumn("may_go", may_go(F.col("row.doc_id").cast("long")))
    keyed = marked.where("may_go").withColumn("row_key", row_key(F.col("row.doc_id").cast("long"), F.col("row.text")))
    w = Window.partitionBy("row_key").orderBy("row_key")
    judged = keyed.join(stage(g.where("keep").select("row_key").distinct()), "row_key").withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return marked.where("not may_go").select("row.*").unionByName(judged.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).drop("row_key")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), r(node, low) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a WHERE r.low < l.b
), c AS (
  SELECT node, min(low) AS low FROM r GROUP BY node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
"""
