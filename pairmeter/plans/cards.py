"""Documents assembled from the observations, one per unit, with the table layout chosen by the
supplier number; and the table of what a correct reader must find in them (the SQL twin)."""

from pyspark.sql import functions as F

from pairmeter.plans.staging import stage
from pairmeter.plans.views import OBS_SQL, obs

TASK_LABEL = {1: "MMLU (5-shot)", 2: "MMLU-Pro (5-shot)", 3: "ARC-Challenge (25-shot)", 4: "GSM8K (5-shot)",
              5: "Math-lvl-5 (4-shot)", 6: "GPQA (0-shot)", 7: "HumanEval+"}
TASK_NAME = {1: ("mmlu", 14042), 2: ("mmlu_pro", 12032), 3: ("arc_challenge", 1172), 4: ("gsm8k", 1319),
             5: ("math_lvl5", 1324), 6: ("gpqa_main", 448), 7: ("humaneval_plus", 164)}
SUFFIX = {"af": "-FP8-dynamic", "ao": "-quantized.w8a16", "rf": "-NVFP4", "nf": "-quantized.w4a16",
          "ro": "-quantized.w8a8", "no": "-FP8"}
PARSED = {"af": ("fp8_dynamic", 8, 8, "fp"), "ao": ("w8a16", 8, 16, "int"), "rf": ("nvfp4", 4, 4, "fp"),
          "nf": ("w4a16", 4, 16, "int"), "ro": ("w8a8_int", 8, 8, "int"), "no": ("fp8", 8, 8, "fp")}
STEM = ["Meta-Llama-3.1", "Llama-4-Scout", "Qwen2.5", "Qwen3", "Mixtral", "Phi-3", "gemma-2", "granite", "Foo"]
FAMILY = ["llama-3", "llama-4", "qwen2.5", "qwen3", "mistral", "phi-3", "gemma-2", "granite", "other"]


def _pick(col, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (col % len(values) + 1).cast("int"))


def _map(col, d):
    return F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), col)


def cards(spark, sf):
    """(doc_id, text, n_bytes)."""
    k = F.substring("base_model", 2, 12).cast("int")
    d = obs(spark, sf).groupBy("model", "base_model", "scheme", "benchmark").agg(
        F.max("acc_before").alias("b"), (F.floor(F.max("acc_after") * 100 + 1e-6) / 100).alias("a"))
    d = d.withColumn("t", F.substring("benchmark", 5, 3).cast("int"))
    items = F.sort_array(F.collect_list(F.struct("t", "b", "a")))
    d = d.groupBy("model", "base_model", "scheme").agg(items.alias("i")).withColumn("k", k)
    no_token = (F.col("scheme") == "ro") & (F.col("k") % 5 == 0)
    size = F.when(F.col("k") % 11 == 0, "").when(F.col("k") % 9 == 4, "-8x7B").otherwise(F.concat(F.lit("-"), F.col("k") % 13 + 1, F.lit("B")))
    name = F.concat(F.lit("Pub"), F.col("k") % 4, F.lit("/"), _pick(F.col("k"), STEM), size, F.lit("-Instruct-S"), F.col("k"),
                    F.when(no_token, F.concat(F.lit("-x"), "scheme")).otherwise(_map(F.col("scheme"), SUFFIX)))
    f1, f2 = (lambda c: F.format_string("%.1f", c)), (lambda c: F.format_string("%.2f", c))
    label = lambda x: _map(x["t"], TASK_LABEL)
    tag = lambda cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit(" </td>")) for c in cells], F.lit("</tr>\n"))
    head = lambda cells: F.lit("<tr>" + "".join(f"<th>{c}</th>" for c in cells) + "</tr>\n")
    pipe = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))
    phead = lambda cells: F.lit("| " + " | ".join(cells) + " |\n|" + "---|" * len(cells) + "\n")
    body = lambda row: F.array_join(F.transform("i", row), "")
    rec = lambda x: F.concat(F.format_string("%.2f", 100 * x["a"] / x["b"]), F.lit("%"))
    html = lambda h, row, extra=F.lit(""): F.concat(F.lit("<table>\n"), head(h), body(row), extra, F.lit("</table>\n"))
    md = lambda h, row: F.concat(F.lit("\n"), phead(h), body(row), F.lit("\n"))
    standard = ["Benchmark", "Base", "Quant (this model)", "Recovery"]
    first = F.col("i")[0]
    extra = F.concat(
        tag([label(first), f1(first["b"] / 2), f2(first["a"] / 2), rec(first)]),
        tag([F.lit("<b>Average</b>"), F.lit("50.00"), F.lit("50.00"), F.lit("100.0%")]),
        tag([F.lit("FooBench (3-shot)"), F.lit("50.00"), F.lit("50.00"), F.lit("100.0%")]))
    row3 = lambda x: tag([label(x), f1(x["b"]), f2(x["a"]), rec(x)])
    layouts = [
        html(standard, row3),
        html(["Benchmark", "Quantized", "Base", "Recovery"], lambda x: tag([label(x), f2(x["a"]), f1(x["b"]), rec(x)])),
        md(["Benchmark", "Recovery", "Base", "FP8"], lambda x: pipe([label(x), rec(x), f1(x["b"]), f2(x["a"])])),
        F.when(F.col("k") % 16 == 3, md(["Benchmark", "Base", "Quantized"], lambda x: pipe([label(x), f1(x["b"]), f2(x["a"])])))
         .otherwise(md(["Benchmark", "Quantized", "Base"], lambda x: pipe([label(x), f2(x["a"]), F.concat(F.lit("**"), f1(x["b"]), F.lit("**"))]))),
        md(["Benchmark", "BF16", "W8A8", "FP8", "INT4"],
           lambda x: pipe([label(x), f1(x["b"]), f2(x["a"]), f2(F.floor(x["a"] * 50 + 1e-6) / 100), f2(F.floor(x["a"] * 25 + 1e-6) / 100)])),
        html(standard, lambda x: tag([label(x), f1(x["b"]), f2(x["a"]), F.format_string("%.2f", 100 * x["a"] / x["b"] + 30)])),
        html(standard, lambda x: tag([label(x), F.format_string("%.4f", x["b"] / 100), F.format_string("%.4f", x["a"] / 100), rec(x)])),
        F.concat(html(standard, row3, extra), F.lit("\n## Inference Performance\n"),
                 html(standard, lambda x: tag([F.lit("Arena-Hard"), f1(x["b"]), f2(x["a"]), rec(x)]))),
    ]
    layout = F.element_at(F.array(*layouts), (F.col("k") % 8 + 1).cast("int"))
    recipe = F.when(F.col("k") % 3 == 0, "Quantized with GPTQ via llm-compressor==0.3.1, num_calibration_samples=512, group_size: 128.") \
        .when(F.col("k") % 3 == 1, "Weights rounded by AWQ, max_seq_length 2048.").otherwise("No details are given.")
    text = F.when(F.col("k") % 13 == 0, F.lit("stub")).otherwise(F.concat(
        F.lit("# Card\nbase_model: see below\n"), recipe, F.lit(" " + "Background text about this model card. " * 6),
        F.lit("\n## Evaluation\nEvaluated with lm-eval.\n"), layout, F.lit("\nEnd of the card.\n")))
    docs = stage(d.select(name.alias("doc_id"), text.alias("text")))
    return docs.withColumn("n_bytes", F.octet_length("text").cast("long"))


def _sql_case(col, d, quote=True):
    q = (lambda v: f"'{v}'") if quote else str
    return f"CASE {col} " + " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v)}" for k, v in d.items()) + " END"


_STEM_CASE = _sql_case("k % 9", dict(enumerate(STEM)))
CARDS_SQL = OBS_SQL + f""", cell AS (
  SELECT model, base_model AS sup, scheme AS sch, CAST(substr(base_model, 2) AS INT) AS k, CAST(substr(benchmark, 5) AS INT) AS t,
    max(acc_before) AS b, floor(max(acc_after) * 100 + 1e-6) / 100 AS a FROM obs GROUP BY ALL),
doc AS (SELECT DISTINCT model AS unit, k, sch, k % 8 AS layout,
    {_STEM_CASE} || CASE WHEN k % 11 = 0 THEN '' WHEN k % 9 = 4 THEN '-8x7B' ELSE '-' || (k % 13 + 1) || 'B' END || '-Instruct-S' || k AS stem,
    CASE WHEN sch = 'ro' AND k % 5 = 0 THEN '-x' || sch ELSE {_sql_case('sch', SUFFIX)} END AS suffix,
    CASE WHEN k % 13 = 0 THEN 'empty_or_missing_card' WHEN sch = 'ro' AND k % 5 = 0 THEN 'no_recognized_scheme'
         WHEN k % 11 = 0 THEN 'no_param_count_in_name' WHEN k % 9 = 8 THEN 'unrecognized_family' END AS gate FROM cell),
card AS (SELECT *, 'Pub' || (k % 4) || '/' || stem || suffix AS doc_id,
    CASE WHEN k % 9 = 4 THEN 56.0 ELSE k % 13 + 1 END::double AS params_b, {_sql_case('k % 9', dict(enumerate(FAMILY)))} AS fam,
    CASE k % 3 WHEN 0 THEN 'gptq' WHEN 1 THEN 'awq' ELSE CASE WHEN sch IN ('af', 'rf', 'no') THEN 'rtn' ELSE 'unknown' END END AS meth FROM doc),
hit AS (SELECT c.doc_id, c.stem, c.fam, c.params_b, c.meth, c.sch, c.layout, cell.t, {_sql_case('cell.t', {k: v[0] for k, v in TASK_NAME.items()})} AS task,
    {_sql_case('cell.t', {k: v[1] for k, v in TASK_NAME.items()}, False)} AS items, b, a,
    row_number() OVER (PARTITION BY c.doc_id ORDER BY cell.t) AS pos FROM card c JOIN cell ON cell.model = c.unit WHERE gate IS NULL),
kept0 AS (SELECT *, CASE layout WHEN 3 THEN 'header_only' WHEN 4 THEN 'multicol' ELSE 'arith' END AS orient FROM hit WHERE layout NOT IN (5, 6) AND a > 0),
kept AS (SELECT doc_id AS model, stem AS base_model, fam AS family, params_b, {_sql_case('sch', {k: v[0] for k, v in PARSED.items()})} AS scheme, meth AS method,
    CASE WHEN task = 'gpqa_main' AND hi - lo > 5 AND b <> lo THEN 'gpqa_ambiguous_46' ELSE task END AS benchmark, items AS n_items,
    b AS acc_before, a AS acc_after, round_even(a - b, 4) AS delta, orient AS orient_src, CASE WHEN orient = 'arith' THEN 1 ELSE 0 END AS verified
  FROM (SELECT *, min(b) FILTER (WHERE task = 'gpqa_main') OVER (PARTITION BY stem) AS lo, max(b) FILTER (WHERE task = 'gpqa_main') OVER (PARTITION BY stem) AS hi FROM kept0)),
rejected AS (SELECT doc_id AS model, '-' AS benchmark, gate AS reason FROM card WHERE gate IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, '-', 'accuracy_on_0_1_scale' FROM hit WHERE layout = 6
  UNION ALL SELECT doc_id, task, 'recovery_mismatch' FROM hit WHERE layout = 5 OR (layout NOT IN (3, 4, 6) AND a = 0)
  UNION ALL SELECT doc_id, task, 'duplicate_benchmark_discarded' FROM hit, range(2) WHERE layout = 4
  UNION ALL SELECT doc_id, task, 'duplicate_benchmark_discarded' FROM hit WHERE layout = 7 AND pos = 1
  UNION ALL SELECT DISTINCT doc_id, 'Average', 'aggregate_row_ignored' FROM hit WHERE layout = 7
  UNION ALL SELECT DISTINCT doc_id, 'FooBench (3-shot)', 'benchmark_not_whitelisted' FROM hit WHERE layout = 7)"""
