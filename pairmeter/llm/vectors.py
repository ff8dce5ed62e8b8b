"""Near-duplicate vectors by sorted projection passes.

In every pass the vectors of a label are put in lexicographic order of ``BITS`` concatenated sign hashes
(random hyperplanes of that pass) and cut into tiles; a vector is compared with its own and the
neighbouring tiles. Two vectors at cosine 0.93 agree on a hash bit with probability 0.88 and share a tile
of a label of n vectors when they agree on log2(n / TILE) leading bits; the number of passes follows from
each label's size, so that a pair is missed by all of them with a probability below ``MISS``. Where more vectors than a tile share a long prefix of the order (a dense
group), the whole run is compared, tile by tile, so the window never cuts a group short.

Cosines are taken in double precision, pair by pair of tiles, inside tasks. No pair leaves a task: a
link is counted in the first pass that compares the pair, which both rows can tell from their tiles and
runs in the passes before, and a comparison returns one row per vector: its new links and one spanning
link. Equal vectors are one unit from the start and are only multiplied.

Defined cases: vectors that are null, zero, or hold a null or non-finite component, and vectors without
a label, link with nothing and are their own component; vectors of different lengths link with nothing;
rows that repeat a vec_id are vectors of their own; a null vec_id is kept and loses to any id; an empty
table gives no rows; extra columns are ignored.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairmeter.llm.common import components, ranked, read, stage

COSINE = 0.93
PASSES, BITS, TILE, SPAN = 16, 32, 512, 8  # passes of a small label
AGREE, MISS = 0.88, 1e-5
_GROUP = ["pass", "label", "dim"]


def _usable():
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("label").isNotNull() & e.isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def n_passes(size: Column, least: int = PASSES) -> Column:
    """Passes over a label of ``size`` vectors: (1 - AGREE ** log2(size / TILE)) ** passes <= MISS."""
    one = F.lit(1.0) - F.pow(F.lit(AGREE), F.log2(F.greatest(size, F.lit(TILE + 1)) / F.lit(float(TILE))))
    return F.greatest(F.lit(least), F.ceil(F.lit(math.log(MISS)) / F.log(one))).cast("int")


def _hash_keys(seed: int):
    planes = {}

    def keys(frames):
        for f in frames:
            out = []
            for (dim, passes), part in f.groupby([f["embedding"].str.len(), "passes"]):
                for k in range(int(passes)):
                    if (dim, k) not in planes:
                        planes[dim, k] = np.random.default_rng([seed, int(dim), k]).standard_normal((int(dim), BITS))
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                k = np.stack([(x @ planes[dim, k] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)) for k in range(int(passes))], axis=1)
                out.append(pd.DataFrame({"unit": part["unit"].to_numpy(), "label": part["label"].to_numpy(), "dim": int(dim), "n": part["n"].to_numpy(),
                                         "vec": [r.tobytes() for r in x], "keys": list(k)}))
            if out:
                yield pd.concat(out)
    return keys


class _Tile:
    """The rows of one or several tiles as arrays."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.unit, self.n = pdf["unit"].to_numpy(), pdf["n"].to_numpy()
        x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(len(pdf), dim)
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.tiles, self.runs = np.stack(pdf["tiles"].to_numpy()), np.stack(pdf["runs"].to_numpy())

    def __len__(self):
        return len(self.unit)


def _links(a: _Tile, b: _Tile, at: int, cosine: float, same: bool):
    """Index pairs at or above the cosine, and whether no pass before ``at`` has compared them."""
    i, j = np.nonzero(a.x @ b.x.T >= cosine)
    if same:
        i, j = i[i < j], j[i < j]
    seen = np.zeros(len(i), dtype=bool)
    for q in range(at):
        seen |= (np.abs(a.tiles[i, q] - b.tiles[j, q]) <= 1) | (a.runs[i, q] == b.runs[j, q])
    return i, j, ~seen


class _Found:
    """Links counted so far and a local union of the rows of one comparison."""

    def __init__(self, n: int):
        self.count, self.low = np.zeros(n, np.int64), np.arange(n)

    def add(self, i, j, new, weight_i, weight_j):
        np.add.at(self.count, i[new], weight_j[new])
        np.add.at(self.count, j[new], weight_i[new])
        while len(i):
            m = np.minimum(self.low[i], self.low[j])
            if np.array_equal(m, self.low[i]) and np.array_equal(m, self.low[j]):
                break
            np.minimum.at(self.low, self.low[i], m)
            np.minimum.at(self.low, self.low[j], m)
            np.minimum.at(self.low, i, m)
            np.minimum.at(self.low, j, m)
            self.low = self.low[self.low]

    def frame(self, unit):
        keep = (self.count > 0) | (self.low != np.arange(len(unit)))
        return pd.DataFrame({"unit": unit[keep], "links": self.count[keep], "root": unit[self.low[keep]]})


_OUT = "unit long, links long, root long"


def _compare_neighbours(cosine: float):
    def compare(key, pdf):
        at, dim, block = int(key[0]), int(key[2]), int(key[3])
        pdf = pdf.sort_values(["tile", "unit"], ignore_index=True)
        t, tile = _Tile(pdf, dim), pdf["tile"].to_numpy()
        found = _Found(len(t))
        for own in range(block * SPAN, (block + 1) * SPAN):
            a = np.flatnonzero(tile == own)
            if not len(a):
                break
            left = _part(t, a)
            for other in (own, own + 1):
                b = a if other == own else np.flatnonzero(tile == other)
                if len(b):
                    i, j, new = _links(left, _part(t, b), at, cosine, other == own)
                    found.add(a[i], b[j], new, t.n[a[i]], t.n[b[j]])
        return found.frame(t.unit)
    return compare


def _part(t: _Tile, at) -> _Tile:
    p = object.__new__(_Tile)
    p.unit, p.n, p.x, p.tiles, p.runs = t.unit[at], t.n[at], t.x[at], t.tiles[at], t.runs[at]
    return p


def _compare_apart(cosine: float):
    def compare(key, pdf):
        t = _Tile(pdf, int(key[2]))
        left = pdf["left"].to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        found = _Found(len(t))
        i, j, new = _links(_part(t, a), _part(t, b), int(key[0]), cosine, False)
        found.add(a[i], b[j], new, t.n[a[i]], t.n[b[j]])
        return found.frame(t.unit)
    return compare


def units(vectors: DataFrame) -> DataFrame:
    """Distinct usable (label, embedding) with the number of rows and the smallest vec_id."""
    u = vectors.where(_usable()).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low_id"))
    return stage(u.withColumn("unit", F.monotonically_increasing_id()))


def link_units(u: DataFrame, cosine: float = COSINE, passes: int = PASSES, seed: int = 7) -> DataFrame:
    """(unit, links, root): rows counted as linked with the unit, and links that span the components."""
    label = u.schema["label"].dataType.simpleString()
    sizes = stage(u.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("size")).withColumn("passes", n_passes(F.col("size"), passes)))
    of = sizes.select(F.col("label").alias("of"), "dim", "passes")
    rows = u.join(of, (F.col("label") == F.col("of")) & (F.size("embedding") == F.col("dim"))).select("unit", "label", "embedding", "n", "passes")
    keyed = stage(rows.mapInPandas(_hash_keys(seed), f"unit long, label {label}, dim int, n long, vec binary, keys array<long>"))
    # so many leading bits that vectors without dense groups would fill an eighth of a tile
    bits = F.greatest(F.lit(1), F.least(F.lit(BITS), F.ceil(F.log2(F.col("size") * 8 / TILE)))).cast("int")
    sizes = stage(sizes.withColumn("bits", bits))
    long = keyed.select("unit", "label", "dim", F.posexplode("keys").alias("pass", "key"))
    placed = ranked(long, [F.col("pass"), F.col("label"), F.col("dim"), F.col("key"), F.xxhash64("pass", "unit"), F.col("unit")])
    placed = stage(placed)
    first = placed.groupBy(*_GROUP).agg(F.min("rank").alias("first"))
    placed = stage(placed.join(first, _GROUP).join(sizes.select("label", "dim", "bits"), ["label", "dim"]).select(
        "unit", *_GROUP, F.floor((F.col("rank") - F.col("first")) / TILE).cast("int").alias("tile"),
        F.expr(f"cast(shiftright(key, {BITS} - bits) as long)").alias("run")))
    cells = placed.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("pass", "tile", "run"))).alias("c"))
    full = stage(keyed.drop("keys").join(cells, "unit").select(
        "unit", "label", "dim", "n", "vec", F.transform("c", lambda x: x["tile"]).alias("tiles"), F.transform("c", lambda x: x["run"]).alias("runs")))
    each = full.withColumn("pass", F.explode(F.sequence(F.lit(0), F.size("tiles") - 1))).withColumn("tile", F.expr("tiles[pass]"))
    block = F.floor(F.col("tile") / SPAN).cast("int")
    blocks = F.when((F.col("tile") % SPAN == 0) & (F.col("tile") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    near = (each.withColumn("block", F.explode(blocks)).groupBy("pass", "label", "dim", "block")
                .applyInPandas(_compare_neighbours(cosine), _OUT))
    runs = (placed.groupBy(*_GROUP, "run").agg(F.min("tile").alias("from"), F.max("tile").alias("to")).where("to - from >= 2"))
    apart = (runs.select(*_GROUP, "run", "to", F.explode(F.expr("sequence(from, to - 2)")).alias("i"))
                 .select(*_GROUP, "run", "i", F.explode(F.expr("sequence(i + 2, to)")).alias("j")))
    apart = stage(apart)
    if apart.isEmpty():
        return stage(near)
    mine = each.withColumn("run", F.expr("runs[pass]"))
    side = lambda t, left: (mine.join(apart.withColumnRenamed(t, "tile"), [*_GROUP, "run", "tile"])
                            .withColumnRenamed("tile", t).withColumn("left", F.lit(left)))
    far = side("i", True).unionByName(side("j", False)).groupBy("pass", "label", "dim", "run", "i", "j").applyInPandas(_compare_apart(cosine), _OUT)
    return stage(near.unionByName(far))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``."""
    v = vectors.select("vec_id", "embedding", "label")
    u = units(v)
    links = link_units(u, cosine, passes, seed)
    node = components(links.select(F.col("unit").alias("a"), F.col("root").alias("b")))
    in_comp = u.join(node.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    low = in_comp.groupBy("component").agg(F.min("low_id").alias("component_id"))
    counts = links.groupBy("unit").agg(F.sum("links").alias("links"))
    out = stage(in_comp.join(low, "component").join(counts, "unit", "left")
                .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    good = v.where(_usable()).join(out, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    bad = v.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r(node, low) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a WHERE r.low < l.b
), c AS (
  SELECT node, min(low) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
"""
