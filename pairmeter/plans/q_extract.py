"""Queries: documents to observations."""

from pyspark.sql import functions as F

from pairmeter.functions import labels as L
from pairmeter.functions.exprs import r6
from pairmeter.operators import extract as X
from pairmeter.operators import tables as T
from pairmeter.plans.cards import CARDS_SQL, TASK_LABEL, cards
from pairmeter.plans.registry import query
from pairmeter.plans.sql import r6 as R
from pairmeter.plans.views import table
from pairmeter.sources import readers

_COLS = "model, base_model, family, params_b, scheme, method, benchmark, n_items, acc_before, acc_after, delta, orient_src, verified"


@query("ex_observations", f"WITH {CARDS_SQL} SELECT {_COLS} FROM kept")
def observations(spark, sf):
    rows, _ = X.extract(cards(spark, sf))
    return rows.select(*_COLS.split(", "))


@query("ex22_reject_log", f"WITH {CARDS_SQL} SELECT model, benchmark, reason FROM rejected")
def rejects(spark, sf):
    return X.extract(cards(spark, sf))[1]


@query("ex22_reject_accounting", f"""WITH {CARDS_SQL} SELECT 'reject' AS kind, reason AS name, count(*) AS n FROM rejected
WHERE reason NOT IN ('empty_or_missing_card', 'no_recognized_scheme', 'no_param_count_in_name') GROUP BY reason
UNION ALL SELECT 'orientation', orient_src, count(*) FROM kept GROUP BY orient_src""")
def accounting(spark, sf):
    return X.accounting(*X.extract(cards(spark, sf)))


@query("ex18_document_fates", f"""WITH {CARDS_SQL}, n AS (SELECT model AS doc_id, count(*) AS rows_kept FROM kept GROUP BY 1)
SELECT doc_id, CASE WHEN gate = 'empty_or_missing_card' THEN 'gate1_' || gate WHEN gate = 'no_recognized_scheme' THEN 'gate2_' || gate
  WHEN gate = 'no_param_count_in_name' THEN 'gate3_' || gate WHEN gate = 'unrecognized_family' THEN 'gate4_' || gate
  WHEN layout = 6 THEN 'gate5_accuracy_on_0_1_scale' WHEN rows_kept IS NULL THEN 'gate6_no_benchmark_rows_survived' ELSE 'KEPT' END AS fate,
  coalesce(rows_kept, 0) AS rows_kept FROM card LEFT JOIN n USING (doc_id)""")
def fates(spark, sf):
    docs = cards(spark, sf)
    return X.fates(docs, *X.extract(docs))


@query("ex21_reconciliation", f"""WITH {CARDS_SQL} SELECT base_model, count(*) FILTER (WHERE benchmark = 'gpqa_main') AS kept_label,
  count(*) FILTER (WHERE benchmark = 'gpqa_ambiguous_46') AS parked FROM kept WHERE benchmark LIKE 'gpqa%' GROUP BY base_model""")
def reconciliation(spark, sf):
    rows, _ = X.extract(cards(spark, sf))
    n = lambda t: F.sum((F.col("benchmark") == t).cast("long"))
    return rows.where("benchmark like 'gpqa%'").groupBy("base_model").agg(
        n("gpqa_main").alias("kept_label"), n("gpqa_ambiguous_46").alias("parked"))


@query("ex19_first_table_wins", f"""WITH {CARDS_SQL} SELECT model, benchmark, count(*) AS discarded FROM rejected WHERE reason = 'duplicate_benchmark_discarded' GROUP BY ALL""")
def first_wins(spark, sf):
    _, rej = X.extract(cards(spark, sf))
    return rej.where("reason = 'duplicate_benchmark_discarded'").groupBy("model", "benchmark").agg(F.count("*").alias("discarded"))


_LAB = "CASE t " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TASK_LABEL.items()) + " END"


# rows of three numbers: layout 6 prints shares of one, layout 7 repeats its first task at half the values
_TRIPLES = """three AS (SELECT doc_id, t, task, layout, CASE WHEN layout = 6 THEN b / 100 ELSE b END AS b, CASE WHEN layout = 6 THEN a / 100 ELSE a END AS a FROM hit WHERE layout IN (0, 1, 2, 5, 6, 7)
  UNION ALL SELECT doc_id, t, task, layout, b / 2, floor((round(a * 100) + 1) / 2) / 100 FROM hit WHERE layout = 7 AND pos = 1)"""
_THREE = (0, 1, 2, 5, 6, 7)


@query("ex9_orientation_solve", f"""WITH {CARDS_SQL}, {_TRIPLES} SELECT doc_id, {_LAB} AS label, CASE WHEN layout = 5 OR a = 0 THEN NULL ELSE b END AS before,
  CASE WHEN layout = 5 OR a = 0 THEN NULL ELSE a END AS after, CASE WHEN layout = 5 OR a = 0 THEN 'reject' ELSE 'arith' END AS orient FROM three""")
def orientation(spark, sf):
    k = F.regexp_extract("doc_id", r"-S(\d+)-", 1).cast("int") % 8
    p = X.parsed_rows(cards(spark, sf)).where(k.isin(*_THREE)).where("emits is not null")
    return p.select("doc_id", "label", F.explode("emits").alias("e")).select(
        "doc_id", "label", "e.before", "e.after", "e.orient")


@query("ex10_wide_unpivot", f"""WITH {CARDS_SQL} SELECT doc_id, task, d AS pos, b AS before, floor(a * 100 / pow(2, d) + 1e-6) / 100 AS after_2dp FROM hit, range(3) r(d) WHERE layout = 4""")
def wide(spark, sf):
    p = X.parsed_rows(cards(spark, sf)).where("size(nums) > 3 and emits is not null")
    e = p.select("doc_id", "task", F.posexplode("emits").alias("pos", "e"))
    return e.select("doc_id", "task", F.col("pos").cast("long").alias("pos"), "e.before", F.col("e.after").alias("after_2dp"))


@query("ex11_two_column_rows", f"""WITH {CARDS_SQL} SELECT doc_id, task, b AS before, a AS after, 'header_only' AS orient FROM hit WHERE layout = 3""")
def two_columns(spark, sf):
    p = X.parsed_rows(cards(spark, sf)).where("size(nums) = 2 and emits is not null")
    return p.select("doc_id", "task", F.explode("emits").alias("e")).select("doc_id", "task", "e.before", "e.after", "e.orient")


@query("ex20_range_and_delta", f"""WITH {CARDS_SQL} SELECT model, benchmark, delta FROM kept""")
def ranged(spark, sf):
    return X.extract(cards(spark, sf))[0].select("model", "benchmark", "delta")


@query("ex13_17_identity_fields", f"""WITH {CARDS_SQL} SELECT doc_id, CASE WHEN sch = 'ro' AND k % 5 = 0 THEN NULL ELSE CASE sch WHEN 'af' THEN 'fp8_dynamic' WHEN 'ao' THEN 'w8a16' WHEN 'rf' THEN 'nvfp4' WHEN 'nf' THEN 'w4a16' WHEN 'ro' THEN 'w8a8_int' ELSE 'fp8' END END AS scheme,
  CASE WHEN k % 11 <> 0 THEN params_b END AS params_b, fam AS family, CASE WHEN sch = 'ro' AND k % 5 = 0 THEN stem || suffix ELSE stem END AS base_model,
  CASE WHEN k % 13 = 0 THEN CASE WHEN sch IN ('af', 'rf', 'no') THEN 'rtn' ELSE 'unknown' END ELSE meth END AS method, 1 AS is_instruct FROM card""")
def identity(spark, sf):
    return X.describe(cards(spark, sf)).select("doc_id", "scheme", "params_b", "family", "base_model", "method", "is_instruct")


# Every document with a body, gated or not, with the cells its tables must hold. Halves are rounded up, as
# the generator's formatter rounds them.
_F1, _F2, _F4 = (lambda v: f"printf('%.1f', {v})"), (lambda v: f"printf('%.2f', floor(({v}) * 100 + 0.5 + 1e-9) / 100)"), (lambda v: f"printf('%.4f', {v})")
_REC = _F2("100 * a / b") + " || '%'"
_CELLS_SQL = f"""{CARDS_SQL}, body AS (SELECT c.doc_id, c.layout, c.k, x.t, x.b, x.a, {_LAB.replace(' t ', ' x.t ')} AS label, row_number() OVER (PARTITION BY c.doc_id ORDER BY x.t) AS pos
  FROM card c JOIN cell x ON x.model = c.unit WHERE c.k % 13 <> 0), last AS (SELECT doc_id, max(pos) AS m FROM body GROUP BY 1)"""


def _cells(tables):
    """(doc_id, table_no, row_no, cells) of nested tables, a row's cells joined by bars."""
    rows = tables.select("doc_id", F.posexplode("tables").alias("table_no", "rows"))
    rows = rows.select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.posexplode("rows").alias("row_no", "c"))
    return rows.select("doc_id", "table_no", F.col("row_no").cast("long").alias("row_no"), F.array_join("c", "|").alias("cells"))


@query("ex2_html_tables", f"""WITH {_CELLS_SQL}, r AS (
  SELECT doc_id, 0 AS table_no, pos AS row_no, label || '|' || CASE layout WHEN 1 THEN {_F2('a')} || '|' || {_F1('b')} WHEN 6 THEN {_F4('b / 100')} || '|' || {_F4('a / 100')} ELSE {_F1('b')} || '|' || {_F2('a')} END
    || '|' || CASE layout WHEN 5 THEN {_F2('100 * a / b + 30')} ELSE {_REC} END AS cells FROM body WHERE layout IN (0, 1, 5, 6, 7)
  UNION ALL SELECT doc_id, 0, m + 1, label || '|' || {_F1('b / 2')} || '|' || {_F2('a / 2')} || '|' || {_REC} FROM body JOIN last USING (doc_id) WHERE layout = 7 AND pos = 1
  UNION ALL SELECT doc_id, 0, m + 1 + i, ['Average', 'FooBench (3-shot)'][i] || '|50.00|50.00|100.0%' FROM body JOIN last USING (doc_id), range(1, 3) g(i) WHERE layout = 7 AND pos = 1
  UNION ALL SELECT doc_id, 1, pos, 'Arena-Hard|' || {_F1('b')} || '|' || {_F2('a')} || '|' || {_REC} FROM body WHERE layout = 7
  UNION ALL SELECT DISTINCT doc_id, tbl, 0, CASE layout WHEN 1 THEN 'Benchmark|Quantized|Base|Recovery' ELSE 'Benchmark|Base|Quant (this model)|Recovery' END
    FROM body, range(2) g(tbl) WHERE layout IN (0, 1, 5, 6, 7) AND (tbl = 0 OR layout = 7))
SELECT doc_id, table_no::bigint AS table_no, row_no::bigint AS row_no, cells FROM r""")
def html(spark, sf):
    return _cells(cards(spark, sf).select("doc_id", T.html_tables(F.col("text")).alias("tables")))


@query("ex3_pipe_tables", f"""WITH {_CELLS_SQL}, r AS (
  SELECT doc_id, pos AS row_no, label || '|' || CASE WHEN layout = 2 THEN {_REC} || '|' || {_F1('b')} || '|' || {_F2('a')} WHEN layout = 4 THEN
      {_F1('b')} || '|' || {_F2('a')} || '|' || {_F2('floor(a * 50 + 1e-6) / 100')} || '|' || {_F2('floor(a * 25 + 1e-6) / 100')}
    WHEN k % 16 = 3 THEN {_F1('b')} || '|' || {_F2('a')} ELSE {_F2('a')} || '|**' || {_F1('b')} || '**' END AS cells FROM body WHERE layout IN (2, 3, 4)
  UNION ALL SELECT DISTINCT doc_id, 0, CASE WHEN layout = 2 THEN 'Benchmark|Recovery|Base|FP8' WHEN layout = 4 THEN 'Benchmark|BF16|W8A8|FP8|INT4'
    WHEN k % 16 = 3 THEN 'Benchmark|Base|Quantized' ELSE 'Benchmark|Quantized|Base' END FROM body WHERE layout IN (2, 3, 4))
SELECT doc_id, 0::bigint AS table_no, row_no::bigint AS row_no, cells FROM r""")
def pipes(spark, sf):
    return _cells(cards(spark, sf).select("doc_id", T.pipe_tables(F.col("text")).alias("tables")))


@query("ex1_section_window", """WITH s AS (SELECT page_id, html,
  CASE WHEN instr(html, '<article') > 1 THEN instr(html, '<article') - 1 WHEN instr(html, '<main') > 1 THEN instr(html, '<main') - 1 ELSE 0 END AS st FROM pages),
c AS (SELECT *, instr(substr(html, st + 2), '<footer') AS f1, instr(substr(html, st + 2), '</article') AS f2 FROM s)
SELECT page_id, st AS start_at, least(length(html), CASE WHEN f1 > 0 THEN st + f1 ELSE length(html) END, CASE WHEN f2 > 0 THEN st + f2 ELSE length(html) END) AS end_at FROM c""")
def window(spark, sf):
    """The section rule on web pages, with their own markers."""
    t = F.col("html")
    start, end = T.section_bounds(t, ["<article", "<main"], ["<footer", "</article"])
    return table(spark, sf, "pages").select("page_id", start.cast("long").alias("start_at"), end.cast("long").alias("end_at"))




@query("ex4_numeric_cell", """WITH c AS (SELECT obs.*, CASE m WHEN 0 THEN printf('%.1f', l_quantity) WHEN 1 THEN '**' || printf('%.2f', l_quantity) || '**' WHEN 2 THEN printf('%.1f', l_quantity) || '%'
  WHEN 3 THEN printf('%.1f', l_quantity) || ' (25.1 / 26.5)' WHEN 4 THEN 'MMLU (5-shot)' ELSE '' END AS cell FROM (SELECT *, l_orderkey % 6 AS m FROM lineitem) obs)
SELECT cell, CASE WHEN m < 4 THEN l_quantity END AS value, count(*) AS n FROM c GROUP BY ALL""")
def numeric_cell(spark, sf):
    q, m = F.col("l_quantity"), F.col("l_orderkey") % 6
    p = F.format_string("%.1f", q)
    cell = (F.when(m == 0, p).when(m == 1, F.concat(F.lit("**"), F.format_string("%.2f", q), F.lit("**"))).when(m == 2, F.concat(p, F.lit("%")))
            .when(m == 3, F.concat(p, F.lit(" (25.1 / 26.5)"))).when(m == 4, "MMLU (5-shot)").otherwise(""))
    return table(spark, sf, "lineitem").select(cell.alias("cell"), T.number(cell).alias("value")).groupBy("cell", "value").agg(F.count("*").alias("n"))


@query("ex5_trailing_run", """SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'MMLU' ELSE l_returnflag END AS label, 2 + (l_linenumber % 2) AS run,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def trailing_run(spark, sf):
    d = table(spark, sf, "lineitem")
    q = F.format_string("%.2f", "l_quantity")
    even = F.col("l_linenumber") % 2 == 0
    cells = F.when(even, F.array(F.lit("Group"), F.lit("MMLU"), F.lit(""), q, F.concat(q, F.lit("%")))) \
        .otherwise(F.array(F.col("l_returnflag"), q, q, F.concat(q, F.lit("%"))))
    r = d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.parse_row(cells).alias("r"))
    return r.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
                     F.col("r.label").alias("label"), F.size("r.nums").alias("run")).agg(F.count("*").alias("n"))


@query("ex8_recovery_tolerance", f"""WITH {CARDS_SQL}, {_TRIPLES} SELECT doc_id, task,
  {R('100 * (half_a / b + a * half_b / (b * b)) + 0.005 + 1e-9')} AS tol FROM (SELECT *, CASE WHEN layout = 6 THEN 0.00005 ELSE 0.005 END AS half_a, CASE WHEN layout = 6 THEN 0.00005 ELSE 0.05 END AS half_b FROM three)""")
def tolerance(spark, sf):
    k = F.regexp_extract("doc_id", r"-S(\d+)-", 1).cast("int") % 8
    p = X.parsed_rows(cards(spark, sf)).where(k.isin(*_THREE)).where("task is not null")
    # positions of before, after and recovery in the layout's row
    at = lambda usual, swapped, rec_first: F.when(k == 1, swapped).when(k == 2, rec_first).otherwise(usual)
    b, a, r = at(0, 1, 1), at(1, 0, 2), at(2, 2, 0)
    n, raw = (lambda i: F.get("nums", i)), (lambda i: F.get("raw", i))
    return p.select("doc_id", "task", r6(T.recovery_tolerance(n(b), n(a), raw(b), raw(a), raw(r))).alias("tol"))


@query("ex12_task_label", """SELECT l_linenumber AS t, count(*) AS n, CASE l_linenumber WHEN 1 THEN 'mmlu_pro' WHEN 2 THEN 'mmlu_cot' WHEN 3 THEN 'math_lvl5' WHEN 4 THEN NULL WHEN 5 THEN NULL
  WHEN 6 THEN 'gpqa_diamond_cot_5shot' ELSE 'arc_challenge' END AS task FROM lineitem GROUP BY l_linenumber""")
def task_label(spark, sf):
    names = ["MMLU-Pro (5-shot)", "**MMLU (CoT, 0-shot)**", "Math-|v|-5", "MATH-500", "**Average**", "GPQA Diamond (CoT, 5-shot)", "arc_challenge_llama"]
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("l_linenumber"))
    return (table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("t"), L.canonical_task(label).alias("task"))
            .groupBy("t", "task").agg(F.count("*").alias("n")))


@query("ex6_column_layout", f"""WITH {CARDS_SQL} SELECT DISTINCT doc_id, CASE layout WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 3 END AS width, CASE WHEN layout IN (0, 1, 5, 6, 7) THEN 2 WHEN layout = 2 THEN 0 END AS rec_idx,
  CASE layout WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN CASE WHEN CAST(regexp_extract(doc_id, '-S(\\d+)-', 1) AS INT) % 16 = 3 THEN 1 ELSE 0 END WHEN 4 THEN 1 ELSE 1 END AS quant_idx FROM hit""")
def column_layout(spark, sf):
    return X.parsed_rows(cards(spark, sf)).select("doc_id", "width", "rec_idx", "quant_idx").distinct()


@query("ex7_base_column", f"""WITH {CARDS_SQL} SELECT DISTINCT doc_id, 0 AS base_idx FROM hit WHERE layout = 4""")
def base_column(spark, sf):
    p = X.parsed_rows(cards(spark, sf)).where("size(nums) = 4")
    return p.select("doc_id", T.base_column(F.col("header"), F.size("nums")).alias("base_idx")).distinct()


@query("ex23_row_census", f"""WITH {CARDS_SQL}, x AS (SELECT doc_id, layout, count(*) AS m FROM hit GROUP BY ALL), u AS (
  SELECT doc_id, 'header_or_nonnumeric' AS gate, 1 AS n FROM x UNION ALL SELECT doc_id, 'benchmark_not_whitelisted', 2 FROM x WHERE layout = 7
  UNION ALL SELECT doc_id, 'numeric_run_not_2_or_3', m FROM x WHERE layout = 4 UNION ALL SELECT doc_id, 'duplicate_benchmark', 1 FROM x WHERE layout = 7
  UNION ALL SELECT doc_id, 'kept_candidate', m FROM x WHERE layout <> 4) SELECT doc_id, gate, n::bigint AS n FROM u""")
def row_census(spark, sf):
    d = X.describe(cards(spark, sf)).where(X.gate().isNull())
    return X.census_rows(d).groupBy("doc_id", "gate").agg(F.count("*").alias("n"))


@query("ex23_window_census", f"""WITH {CARDS_SQL} SELECT DISTINCT doc_id, CASE WHEN layout = 7 THEN 2 ELSE 1 END AS tables_in_card, 1 AS tables_in_window, CASE WHEN layout = 7 THEN 1 ELSE 0 END AS excluded FROM hit""")
def window_census(spark, sf):
    d = X.describe(cards(spark, sf)).where(X.gate().isNull())
    return X.window_census(d).select("doc_id", "tables_in_card", "tables_in_window", (F.col("tables_in_card") - F.col("tables_in_window")).alias("excluded"))


@query("ex23_silent_labels", f"""WITH {CARDS_SQL}, n AS (SELECT count(DISTINCT doc_id) AS n FROM hit WHERE layout = 7)
SELECT label, n FROM n, (VALUES ('Average'), ('FooBench (3-shot)')) v(label)""")
def silent_labels(spark, sf):
    """The table labels most often left out for want of a known task."""
    d = X.describe(cards(spark, sf)).where(X.gate().isNull())
    return (X.census_rows(d).where("gate = 'benchmark_not_whitelisted'").groupBy("label").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "label").limit(22))


@query("ex24_separate_cohort", f"""WITH {CARDS_SQL}, x AS (SELECT sch, cell.t, k % 9 = 4 AS moe, k FROM card c JOIN cell ON cell.model = c.unit WHERE (gate IS NULL OR gate = 'unrecognized_family') AND layout NOT IN (5, 6) AND a > 0)
SELECT CASE sch WHEN 'af' THEN 'fp8_dynamic' WHEN 'ao' THEN 'w8a16' WHEN 'rf' THEN 'nvfp4' WHEN 'nf' THEN 'w4a16' WHEN 'ro' THEN 'w8a8_int' ELSE 'fp8' END AS scheme,
  count(*) AS n, count(*) FILTER (WHERE moe) AS n_moe FROM x GROUP BY 1""".replace("card c JOIN cell ON cell.model = c.unit", "(SELECT k, unit, gate, layout FROM card) c JOIN (SELECT model, sch, t, a FROM cell) cell ON cell.model = c.unit"))
def separate_cohort(spark, sf):
    """The same extraction for a cohort kept out of the corpus: unknown families allowed, family
    forced, mixtures flagged."""
    from pairmeter.functions.exprs import is_moe
    rows, _ = X.extract(cards(spark, sf), allow_unknown_family=True, reconcile=False)
    rows = rows.withColumns({"family": F.lit("cohort"), "moe": is_moe("base_model")})
    return rows.groupBy("scheme").agg(F.count("*").alias("n"), F.sum(F.col("moe").cast("long")).alias("n_moe"))


@query("q14_funnel", f"""WITH {CARDS_SQL} SELECT 'listed' AS stage, count(*) AS n FROM card UNION ALL SELECT 'quantized', count(*) FROM card WHERE NOT (sch = 'ro' AND k % 5 = 0)
UNION ALL SELECT 'targeted', count(*) FROM card WHERE gate IS NULL UNION ALL SELECT 'kept_rows', count(*) FROM kept UNION ALL SELECT 'modelled_rows', count(*) FROM kept WHERE acc_before >= 20""")
def funnel(spark, sf):
    docs = cards(spark, sf)
    d = X.describe(docs)
    rows, _ = X.extract(docs)
    out = None
    for name, part in (("listed", docs), ("quantized", d.where("scheme is not null")), ("targeted", d.where(X.gate().isNull())),
                       ("kept_rows", rows), ("modelled_rows", readers.keep(rows))):
        n = part.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out
