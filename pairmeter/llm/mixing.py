"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. Tokens are summed by (source, hash bucket); the bucket in which
a source's running sum passes its budget is the only one that is split further, level by level, until
the boundary is a single hash value. One threshold per source then filters the documents: nothing is
sorted, and a source holding a third of the corpus is still only 4,096 sums per level. Budgets nest: a
larger budget has a larger threshold, so it keeps every document a smaller one kept.

Defined cases: a null or empty text has size 0 and is taken or left with its hash; a null source is a
source of its own, last in order; rows equal in doc_id and text share a hash and are taken together; a
source without words has target 0 and none of its documents is taken; an empty table gives no rows.
Extra columns are ignored by ``thresholds`` and kept by ``mix``.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from pairmeter.llm.common import as_row, md5_int, n_words, ranked, read, stage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BITS, LEVELS = 12, 5


def document_hash(doc_id: Column, text: Column) -> Column:
    return md5_int(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """Targets per source from (key, source, source_size): weights repeat in source order, budgets above
    ``most`` times a source's size are cut to it and the excess is shared by weight among the others.

    Every source but the capped ones gets its weight times one common level. The level only rises from
    round to round; a round is two sums over the source table.
    """
    order = [F.col("source").asc_nulls_last()]
    w = F.lit(None)
    for i, x in enumerate(weights):
        w = F.when(F.col("rank") % len(weights) == i, F.lit(float(x))).otherwise(w)
    src = stage(ranked(sizes, order).withColumn("weight", w).drop("rank"))
    cap = F.col("source_size") * F.lit(float(most))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        n, fixed, free = src.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total * share - (fixed or 0.0)) / free
    return src.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def thresholds(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """Per source: key, source_size, target, whole copies of every document, and the hash below which a
    document is taken once more."""
    text = F.col("text")
    rows = stage(docs.select(source_key(F.col("source")).alias("key"), F.col("source").cast("string").alias("source"),
                             n_words(text).alias("size"), document_hash(F.col("doc_id"), text).alias("hash")))
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    state = (targets(sizes, weights, share, most)
             .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
             .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    state = stage(state)
    w = Window.partitionBy("key").orderBy("bucket")
    for depth in range(LEVELS):
        inside = F.shiftright("hash", BITS * (LEVELS - depth)) == F.col("prefix")
        hist = (rows.join(state.select("key", "prefix"), "key").where(inside)
                    .groupBy("key", F.shiftright("hash", BITS * (LEVELS - 1 - depth)).alias("bucket")).agg(F.sum("size").alias("tokens")))
        hit = (hist.withColumn("through", F.sum("tokens").over(w)).join(state, "key")
                   .where(F.col("below") + F.col("through") > F.col("rest"))
                   .groupBy(*[F.col(c) for c in state.columns])
                   .agg(F.min(F.struct("bucket", "through", "tokens")).alias("b")))
        kept = [c for c in state.columns if c not in ("prefix", "below")]
        found = hit.select(*kept, F.col("b.bucket").alias("prefix"),
                           (F.col("below") + F.col("b.through") - F.col("b.tokens")).alias("below"), F.col("b.tokens").alias("leaf"))
        if depth < LEVELS - 1:
            found = found.drop("leaf")
        # a source whose budget no bucket passes (no words at all) has no boundary
        rest = state.join(found.select("key"), "key", "left_anti")
        if "leaf" in found.columns:
            rest = rest.withColumn("leaf", F.lit(0).cast("long"))
        state = stage(found.unionByName(rest))
    nearer = F.col("below") + F.col("leaf") - F.col("rest") < F.col("rest") - F.col("below")
    return state.select("key", "source_size", "target", "copies",
                        F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))


def _copies(hash_: Column) -> Column:
    return F.col("t.copies") + F.when(hash_ < F.col("t.threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns."""
    t = stage(thresholds(docs, weights, share, most))
    d = as_row(docs).withColumn("key", source_key(F.col("row.source")))
    d = d.join(t.alias("t"), "key")
    n = _copies(document_hash(F.col("row.doc_id"), F.col("row.text"))).cast("int")
    return (d.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
             .select("row.*"))


def taken(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes from it."""
    t = stage(thresholds(docs, weights, share, most))
    text = F.col("text")
    d = docs.select("doc_id", source_key(F.col("source")).alias("key"), n_words(text).alias("size"),
                    document_hash(F.col("doc_id"), text).alias("hash"))
    return d.join(t.alias("t"), "key").select("doc_id", "size", "source_size", "target",
                                               (_copies(F.col("hash")) * F.col("size")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), r AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w
), c AS (
  SELECT ratio, (SELECT sum(source_size) FROM r)::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS fixed,
         sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r
), l AS (
  SELECT (total - fixed) / free AS level FROM c WHERE (total - fixed) / free <= ratio ORDER BY ratio LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM l), 0)) AS target FROM r
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t
), h AS (
  SELECT source, hash, sum(size) AS tokens FROM d GROUP BY source, hash
), k AS (
  SELECT h.*, b.target - b.copies * b.source_size AS rest, sum(tokens) OVER (PARTITION BY h.source ORDER BY hash) AS through
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
), x AS (
  SELECT source, hash, through <= rest OR (through - tokens <= rest AND through - rest < rest - (through - tokens)) AS more FROM k
)
SELECT d.doc_id, d.size, b.source_size, b.target, ((b.copies + CASE WHEN x.more THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.hash = x.hash
"""
