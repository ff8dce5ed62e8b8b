"""Documents to verified observations, with a reason for every row that is dropped.

Text is read, windowed and parsed where it lies; only parsed rows are shuffled, once by document
for the first-wins rule. The two outputs share that parsed frame.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairmeter.functions import labels as L, vocab
from pairmeter.operators import tables as X
from pairmeter.plans.staging import stage

NOT_CANDIDATES = ["empty_or_missing_card", "no_recognized_scheme", "no_param_count_in_name"]


def describe(docs: DataFrame) -> DataFrame:
    """Fields read off the id and the text."""
    d = docs.withColumn("_t", L.treatment("doc_id"))
    d = d.withColumns({
        "scheme": F.col("_t.scheme"), "weight_bits": F.col("_t.weight_bits"), "act_bits": F.col("_t.act_bits"),
        "num_type": F.col("_t.num_type"), "params_b": L.params_b("doc_id"), "family": L.family("doc_id"),
        "base_model": L.cluster_key("doc_id"), "is_instruct": L.is_instruct("doc_id")}).drop("_t")
    return d.withColumn("method", L.method("text", "scheme"))


def gate(allow_unknown_family=False) -> Column:
    """First document gate that fires, null for a candidate."""
    g = (F.when(F.col("n_bytes") < vocab.MIN_DOCUMENT_BYTES, "empty_or_missing_card")
         .when(F.col("scheme").isNull(), "no_recognized_scheme")
         .when(F.col("params_b").isNull(), "no_param_count_in_name"))
    return g if allow_unknown_family else g.when(F.col("family") == "other", "unrecognized_family")


FIELDS = ["doc_id", "base_model", "family", "params_b", "is_instruct", "scheme", "weight_bits", "act_bits", "num_type", "method"]


def parsed_rows(docs: DataFrame, allow_unknown_family=False) -> DataFrame:
    """Table rows of every candidate document with their readings.

    Written twice on the way: once after the text has been parsed, so the text is read once, and
    once after the columns have been oriented, because observations and rejects both read it.
    """
    d = describe(docs).where(gate(allow_unknown_family).isNull())
    rows = stage(X.table_rows(d.select(*FIELDS, X.section("text").alias("body"))))
    return stage(X.readings(rows.withColumn("task", L.canonical_task("label"))))


def extract(docs: DataFrame, allow_unknown_family=False, reconcile=True):
    """(observations, rejects)."""
    gated = describe(docs).withColumn("reason", gate(allow_unknown_family)).where("reason is not null").select(
        F.col("doc_id").alias("model"), F.lit("-").alias("benchmark"), "reason")
    p = parsed_rows(docs, allow_unknown_family)
    dropped = F.when(F.col("is_data") & F.col("task").isNull(), F.struct(
        F.substring(F.regexp_replace(F.regexp_replace(L.strip("label"), r"^\*+|\*+$", ""), r"\s+", " "), 1, 60).alias("benchmark"),
        F.when(L.is_aggregate("label"), "aggregate_row_ignored").otherwise("benchmark_not_whitelisted").alias("reason"))) \
        .when(F.col("skip").isNotNull(), F.struct(F.col("task").alias("benchmark"), F.col("skip").alias("reason")))
    p = p.withColumn("_drop", dropped).where("emits is not null or _drop is not null")
    # one row per reading; a dropped table row keeps a single row without a reading
    e = p.select(*FIELDS, "table_no", "row_no", "task", "_drop", F.posexplode_outer("emits").alias("seq", "_e"))
    e = e.select(*FIELDS, "table_no", "row_no", "seq", "task", "_drop", F.col("_e.before").alias("acc_before"),
                 F.col("_e.after").alias("acc_after"), F.col("_e.orient").alias("orient_src"))
    doc = Window.partitionBy("doc_id")
    usable = F.col("acc_before").isNotNull()
    slot = Window.partitionBy("doc_id", "task", usable).orderBy("table_no", "row_no", "seq")
    e = e.withColumns({"_scale": F.max("acc_before").over(doc), "_nth": F.row_number().over(slot)})
    in_range = (F.col("acc_before") > 0) & (F.col("acc_before") <= 100) & F.col("acc_after").between(0, 100)
    reason = (F.when(F.col("_drop").isNotNull(), F.col("_drop.reason")).when(~usable, "recovery_mismatch")
              .when(F.col("_nth") > 1, "duplicate_benchmark_discarded").when(~in_range, "out_of_range"))
    scaled = F.coalesce(F.col("_scale") <= 1.0, F.lit(False))
    e = e.withColumns({"reason": reason, "_scaled": scaled})
    rows = e.where("reason is null and not _scaled").select(
        F.col("doc_id").alias("model"), *FIELDS[1:], F.col("task").alias("benchmark"), L.task_items("task").alias("n_items"),
        "acc_before", "acc_after", F.bround(F.col("acc_after") - F.col("acc_before"), 4).alias("delta"), "orient_src",
        F.col("orient_src").isin("arith", "header").cast("int").alias("verified"))
    rejects = e.where("reason is not null and not _scaled").select(
        F.col("doc_id").alias("model"), F.coalesce("_drop.benchmark", "task").alias("benchmark"), "reason")
    whole = e.where("_scaled").select(F.col("doc_id").alias("model"), F.lit("-").alias("benchmark"),
                                      F.lit("accuracy_on_0_1_scale").alias("reason")).distinct()
    rows = reconcile_ambiguous(rows) if reconcile else rows
    return rows, gated.unionByName(rejects).unionByName(whole)


def reconcile_ambiguous(rows: DataFrame) -> DataFrame:
    """Within a cluster, baselines of one task label more than five points apart cannot all be
    that task: the lowest keeps the label, the others are parked."""
    named = F.col("benchmark") == vocab.RECONCILED_TASK
    span = rows.where(named).groupBy("base_model").agg(F.min("acc_before").alias("_lo"), F.max("acc_before").alias("_hi"))
    span = span.where(F.col("_hi") - F.col("_lo") > vocab.RECONCILE_SPREAD).select("base_model", "_lo")
    parked = F.coalesce(named & (F.col("acc_before") != F.col("_lo")), F.lit(False))
    out = rows.join(span, "base_model", "left").withColumn("_p", parked)
    return out.withColumns({
        "benchmark": F.when(F.col("_p"), vocab.AMBIGUOUS_TASK).otherwise(F.col("benchmark")),
        "n_items": F.when(F.col("_p"), vocab.AMBIGUOUS_ITEMS).otherwise(F.col("n_items"))}).drop("_lo", "_p").select(*rows.columns)


def accounting(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rejects by reason (without documents that were never candidates) and rows by orientation."""
    r = (rejects.where(~F.col("reason").isin(*NOT_CANDIDATES)).groupBy(F.col("reason").alias("name"))
         .agg(F.count("*").alias("n")).withColumn("kind", F.lit("reject")))
    o = rows.groupBy(F.col("orient_src").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("orientation"))
    return r.unionByName(o).select("kind", "name", "n")


def fates(docs: DataFrame, rows: DataFrame, rejects: DataFrame, allow_unknown_family=False) -> DataFrame:
    """The gate that decided every document, and the rows it kept."""
    kept = rows.groupBy(F.col("model").alias("doc_id")).agg(F.count("*").alias("rows_kept"))
    scale = rejects.where("reason = 'accuracy_on_0_1_scale'").select(F.col("model").alias("doc_id")).withColumn("_s", F.lit(True))
    d = describe(docs).select("doc_id", gate(allow_unknown_family).alias("gate"))
    d = d.join(kept, "doc_id", "left").join(scale, "doc_id", "left")
    fate = (F.when(F.col("gate") == "empty_or_missing_card", "gate1_empty_or_missing_card")
            .when(F.col("gate") == "no_recognized_scheme", "gate2_no_recognized_scheme")
            .when(F.col("gate") == "no_param_count_in_name", "gate3_no_param_count_in_name")
            .when(F.col("gate") == "unrecognized_family", "gate4_unrecognized_family")
            .when(F.col("_s"), "gate5_accuracy_on_0_1_scale")
            .when(F.col("rows_kept").isNull(), "gate6_no_benchmark_rows_survived").otherwise("KEPT"))
    return d.select("doc_id", fate.alias("fate"), F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"))


def census_rows(docs: DataFrame) -> DataFrame:
    """Every table row of every document with the census' own gate order (not the extractor's):
    header, label, run length, duplicate."""
    rows = stage(X.table_rows(docs.select("doc_id", X.section("text").alias("body")))).withColumn("task", L.canonical_task("label"))
    k = F.size("nums")
    early = (F.when(F.col("label").isNull() | (k == 0), "header_or_nonnumeric").when(F.col("task").isNull(), "benchmark_not_whitelisted")
             .when(~k.isin(2, 3), "numeric_run_not_2_or_3"))
    rows = rows.withColumn("_early", early)
    nth = F.row_number().over(Window.partitionBy("doc_id", "task", F.col("_early").isNull()).orderBy("table_no", "row_no"))
    return rows.withColumn("gate", F.coalesce("_early", F.when(nth > 1, "duplicate_benchmark"), F.lit("kept_candidate"))).select(
        "doc_id", "label", "task", k.alias("n_nums"), "gate")


def window_census(docs: DataFrame) -> DataFrame:
    """Characters and tables inside and outside the section window, per document."""
    t = docs.select("doc_id", "text", X.section("text").alias("body"))
    return t.select("doc_id", F.length("text").alias("chars_total"), F.length("body").alias("chars_in_window"),
                    F.size(X.all_tables(F.col("text"))).alias("tables_in_card"), F.size(X.all_tables(F.col("body"))).alias("tables_in_window"))
