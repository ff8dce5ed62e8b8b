"""Queries: contract and integrity checks, claims, document audits, sources and sinks."""

import uuid

from pyspark.sql import functions as F

from pairmeter.functions.exprs import r6
from pairmeter.operators import audits as Q
from pairmeter.operators import extract as X
from pairmeter.operators import folds as E
from pairmeter.plans.cards import CARDS_SQL, cards
from pairmeter.plans.registry import query
from pairmeter.plans.sql import r6 as R
from pairmeter.plans.staging import shared_dir
from pairmeter.plans.views import OBS_RAW_SQL, OBS_SQL, families, obs, obs_raw, table
from pairmeter.sources import readers, sinks

# planted defects: a blank unit, a wrong delta, an impossible accuracy
_DIRTY = """d AS (SELECT * REPLACE (CASE WHEN n_items % 97 = 0 THEN ' ' ELSE model END AS model, CASE WHEN n_items % 80 = 0 THEN delta + 1 ELSE delta END AS delta,
  CASE WHEN n_items = 1000 AND scheme = 'no' THEN 101 ELSE acc_before END AS acc_before) FROM obs)"""


def _dirty(spark, sf):
    n = F.col("n_items")
    return obs(spark, sf).withColumns({
        "model": F.when(n % 97 == 0, " ").otherwise(F.col("model")), "delta": F.when(n % 80 == 0, F.col("delta") + 1).otherwise(F.col("delta")),
        "acc_before": F.when((n == 1000) & (F.col("scheme") == "no"), 101.0).otherwise(F.col("acc_before"))})


def _check(name, sev, expr):
    return f"SELECT '{name}' AS check, '{sev}' AS severity, ({expr})::bigint AS n_bad"


def _checks_sql(parts):
    return " UNION ALL ".join(_check(*p) for p in parts)


_C = "SELECT count(*) FROM d WHERE "


@query("q1_contract_validation", f"""WITH {OBS_SQL}, {_DIRTY}, ref AS (SELECT base_model, benchmark, avg(acc_before) AS ref FROM obs GROUP BY ALL), c AS ({_checks_sql([
    ('blank_model', 'fail', _C + "trim(model) = ''"), ('blank_base_model', 'fail', _C + 'false'), ('blank_scheme', 'fail', _C + 'false'), ('blank_benchmark', 'fail', _C + 'false'),
    ('non_numeric_acc_before', 'fail', _C + 'acc_before IS NULL'), ('non_numeric_acc_after', 'fail', _C + 'acc_after IS NULL'), ('non_numeric_params_b', 'fail', _C + 'params_b IS NULL'),
    ('scale_0_1', 'fail', 'SELECT (greatest(max(acc_before), max(acc_after)) <= 1)::int FROM d'), ('outside_0_100', 'fail', _C + 'acc_before NOT BETWEEN 0 AND 100 OR acc_after NOT BETWEEN 0 AND 100'),
    ('delta_mismatch', 'fail', _C + 'abs((acc_after - acc_before) - delta) > 1e-6'), ('unknown_task', 'fail', _C + "benchmark NOT IN ('task1', 'task2', 'task3', 'task4', 'task5', 'task6')"),
    ('new_scheme', 'warn', _C + "scheme NOT IN ('af', 'ao', 'nf', 'no')"), ('not_damaging', 'warn', 'SELECT (count(*) FILTER (WHERE acc_after - acc_before < -3) = 0)::int FROM d'),
    ('duplicate_key', 'fail', 'SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d GROUP BY model, benchmark)'),
    ('baseline_drift', 'warn', 'SELECT count(*) FROM d JOIN ref USING (base_model, benchmark) WHERE round(abs(ref - acc_before), 9) > 2')])})
SELECT *, CASE WHEN n_bad > 0 THEN severity ELSE 'ok' END AS status FROM c""")
def contract(spark, sf):
    return Q.validate_contract(_dirty(spark, sf), [f"task{i}" for i in range(1, 7)], ["af", "ao", "nf", "no"], obs(spark, sf))


@query("q2_integrity_audit", f"""WITH {OBS_SQL}, {_DIRTY}, c AS ({_checks_sql([
    ('delta_arithmetic', 'fail', _C + 'abs((acc_after - acc_before) - delta) > 1e-6'), ('range', 'fail', _C + 'acc_before NOT BETWEEN 0.001 AND 100 OR acc_after NOT BETWEEN 0 AND 100'),
    ('duplicate_key', 'fail', 'SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM d GROUP BY model, benchmark)'), ('unit_on_0_1_scale', 'fail', 'SELECT count(*) FROM (SELECT model FROM d GROUP BY model HAVING max(acc_before) <= 1)'),
    ('mean_delta_not_negative', 'fail', 'SELECT (avg(delta) >= 0)::int FROM d'), ('verified_share_low', 'fail', 'SELECT (avg(verified) <= 0.9)::int FROM d'),
    ('large_delta_by_header_only', 'warn', _C + "abs(delta) > 3 AND orient_src = 'header_only'")])})
SELECT *, CASE WHEN n_bad > 0 THEN severity ELSE 'ok' END AS status FROM c""")
def integrity(spark, sf):
    return Q.integrity(_dirty(spark, sf))


@query("q3_token_consistency", f"""WITH {CARDS_SQL} SELECT doc_id AS model, CASE sch WHEN 'ro' THEN k % 5 <> 0 ELSE true END AS ok FROM card""")
def tokens(spark, sf):
    d = X.describe(cards(spark, sf)).select(F.col("doc_id").alias("model"), F.coalesce("scheme", F.lit("none")).alias("scheme"))
    return d.select("model", Q.token_consistent().alias("ok"))


@query("q4_source_reread", f"""WITH {CARDS_SQL} SELECT model, benchmark, CASE WHEN CAST(regexp_extract(base_model, 'S(\\d+)$', 1) AS INT) % 5 = 0 THEN 'absent'
  WHEN CAST(regexp_extract(base_model, 'S(\\d+)$', 1) AS INT) % 7 = 0 THEN 'miss' ELSE 'hit' END AS state FROM kept""")
def reread(spark, sf):
    docs = cards(spark, sf)
    rows, _ = X.extract(docs)
    k = F.regexp_extract("base_model", r"S(\d+)$", 1).cast("int")
    rows = rows.withColumn("acc_after", F.when(k % 7 == 0, F.col("acc_after") + 1000.5).otherwise(F.col("acc_after")))
    kept = docs.where(F.regexp_extract("doc_id", r"-S(\d+)-", 1).cast("int") % 5 != 0)
    return Q.source_reread(rows, kept).select("model", "benchmark", "state")


@query("q5_fold_disjointness", f"""WITH {OBS_SQL}, f AS (SELECT DISTINCT family AS x FROM obs) SELECT a.x || '|' || b.x AS fold, (SELECT count(*) FROM f) AS families, 0::bigint AS overlaps FROM f a JOIN f b ON a.x <> b.x""")
def disjoint(spark, sf):
    seen = obs(spark, sf).select("family").distinct()
    return Q.fold_disjointness(E.family_folds(spark, families(spark, sf)).join(seen, "family", "left_semi"))


# ------------------------------------------------------------------ claims

_CLAIM_SQL = OBS_SQL + """, reg AS (SELECT 'mean::' || scheme AS key, avg(delta) AS value, 0.005 AS tol FROM obs GROUP BY scheme UNION ALL SELECT 'n|' || scheme, count(*), 0 FROM obs GROUP BY scheme),
st AS (SELECT scheme AS doc_id, printf('%.3f', avg(delta) + CASE WHEN scheme = 'nf' THEN 1 ELSE 0 END) AS m, count(*)::varchar AS n FROM obs GROUP BY scheme)"""


def claim_docs(spark, sf):
    """One report text per treatment: tagged mean and count, an unknown key, untagged numerals."""
    s = obs(spark, sf).groupBy("scheme").agg(F.avg("delta").alias("m"), F.count("*").cast("string").alias("n"))
    shown = F.format_string("%.3f", F.col("m") + F.when(F.col("scheme") == "nf", 1.0).otherwise(0.0))
    tag = lambda key, v: F.concat(F.lit("<!-- claim: "), key, F.lit(" = "), v, F.lit(" -->"))
    return s.select(F.col("scheme").alias("doc_id"), F.concat(
        F.lit("Mean effect "), shown, tag(F.concat(F.lit("mean::"), "scheme"), shown), F.lit(" over "), "n", tag(F.concat(F.lit("n\\|"), "scheme"), F.col("n")),
        F.lit(" rows, see `code 4711` and [ref](page_4712.md). "), tag(F.lit("foo::x"), F.lit("4.5")),
        F.lit(" Untagged: 4713.25 and exempt 90.\n```\n4714\n```\n")).alias("text"))


def registry(spark, sf):
    d = obs(spark, sf)
    mean = d.groupBy(F.concat(F.lit("mean::"), "scheme").alias("key")).agg(F.avg("delta").alias("value"), F.lit(0.005).alias("tol"))
    n = d.groupBy(F.concat(F.lit("n|"), "scheme").alias("key")).agg(F.count("*").cast("double").alias("value"), F.lit(0.0).alias("tol"))
    return mean.unionByName(n)


@query("q7_claim_tags", f"""WITH {_CLAIM_SQL} SELECT doc_id, 'mean::' || doc_id AS key, m::double AS stated FROM st UNION ALL SELECT doc_id, 'n|' || doc_id, n::double FROM st UNION ALL SELECT doc_id, 'foo::x', 4.5 FROM st""")
def claim_tags(spark, sf):
    return Q.claims(claim_docs(spark, sf))


@query("j8_claims_against_registry", f"""WITH {_CLAIM_SQL}, c AS (SELECT doc_id, 'mean::' || doc_id AS key, m::double AS stated FROM st UNION ALL SELECT doc_id, 'n|' || doc_id, n::double FROM st UNION ALL SELECT doc_id, 'foo::x', 4.5 FROM st)
SELECT doc_id, key, stated, {R('value')} AS computed, CASE WHEN value IS NULL THEN 'unknown' WHEN abs(stated - value) > tol THEN 'mismatch' ELSE 'ok' END AS status FROM c LEFT JOIN reg USING (key)""")
def claims_checked(spark, sf):
    return Q.check_claims(Q.claims(claim_docs(spark, sf)), registry(spark, sf)).withColumn("computed", r6("computed"))


@query("q8_untraced_numbers", f"""WITH {_CLAIM_SQL} SELECT doc_id, '4713.25' AS raw FROM st""")
def untraced(spark, sf):
    return Q.untraced_numbers(claim_docs(spark, sf), exempt=["90"])


# ------------------------------------------------------------------ documents


@query("src1_document_scan", """SELECT doc_id, strlen(text)::bigint AS n_bytes, strlen(text) < 200 AS is_empty FROM documents""")
def document_scan(spark, sf):
    n = F.octet_length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("n_bytes"), (n < 200).alias("is_empty"))


@query("q9_broken_links", r"""WITH l AS (SELECT page_id AS doc_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages),
t AS (SELECT DISTINCT doc_id, regexp_replace(href, '[#?].*$', '') AS target FROM l WHERE NOT regexp_matches(href, '^(https?://|#)'))
SELECT doc_id, target FROM t WHERE target NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) FROM pages)""")
def links(spark, sf):
    pages = table(spark, sf, "pages")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    targets = pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("target"))
    return Q.broken_links(docs, targets, r'href="([^"]*)"')


_PHRASES = {"license": "licence wording", "password": "credential wording", "all rights": "rights wording"}
_PH = ", ".join(f"('{k}', '{v}')" for k, v in _PHRASES.items())


@query("q10_phrase_blacklist", f"""WITH ph(phrase, why) AS (VALUES {_PH}), d AS (SELECT doc_id, text, phrase, why, string_split(lower(text), phrase) AS parts FROM documents, ph WHERE contains(lower(text), phrase)),
u AS (SELECT doc_id, text, phrase, why, i, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(phrase))::bigint AS pos FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM d)),
c AS (SELECT *, substr(text, greatest(pos - 200, 0) + 1, least(pos, 200) + 200) AS wide, substr(text, greatest(pos - 70, 0) + 1, least(pos, 70) + 70) AS context FROM u)
SELECT doc_id, phrase, why, pos, context FROM c WHERE NOT regexp_matches(wide, '(?i)banned|retracted|apache')""")
def phrases(spark, sf):
    hits = Q.phrase_hits(table(spark, sf, "documents"), _PHRASES, r"(?i)banned|retracted|apache")
    return hits.withColumn("pos", F.col("pos").cast("long"))


@query("q11_prose_defects")
def prose(spark, sf):
    return Q.prose_defects(table(spark, sf, "documents")).groupBy("why").agg(
        F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents"))


@query("q12_hash_pins", """WITH m AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS want FROM documents WHERE doc_id % 4 <> 1),
a AS (SELECT doc_id, sha256(text) AS got FROM documents WHERE doc_id % 9 <> 2)
SELECT coalesce(m.doc_id, a.doc_id)::varchar AS path, CASE WHEN got IS NULL THEN 'absent' WHEN want IS NULL THEN 'unpinned' WHEN want = got THEN 'ok' ELSE 'drift' END AS state FROM m FULL JOIN a ON m.doc_id = a.doc_id""")
def pins(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    path = k.cast("string").alias("path")
    want = d.where(k % 4 != 1).select(path, F.sha2(F.when(k % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return Q.check_pins(want, d.where(k % 9 != 2).select(path, F.sha2("text", 256).alias("sha256")))


@query("q12_pin_summary", """SELECT (SELECT count(*) FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 9 <> 2) AS checked, (SELECT count(*) FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 9 <> 2 AND doc_id % 10 = 0) AS drift,
  (SELECT count(*) FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 9 = 2) AS absent, 'fail' AS exit_state""")
def pin_summary(spark, sf):
    return Q.pin_summary(pins(spark, sf))


SCANNED = {**Q.SECRETS, "email address": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+"}
_SEC = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in SCANNED.items())


@query("q13_secret_scan", f"""WITH p(label, pat) AS (VALUES {_SEC}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, label, unnest(regexp_extract_all(line, pat)) AS match FROM l, p""")
def secrets(spark, sf):
    return Q.scan_lines(table(spark, sf, "documents"), SCANNED).withColumn("line_no", F.col("line_no").cast("long"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {})"


@query("q13_public_addresses", f"""WITH {_LINES.format('documents')}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_.]+')) AS match FROM l),
o AS (SELECT *, list_transform(string_split(match, '.'), lambda x: TRY_CAST(x AS INT)) AS o FROM m WHERE regexp_full_match(match, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}')),
h AS (SELECT *, o[1] * 256 + o[2] AS head FROM o WHERE list_max(o) <= 255)
SELECT doc_id, line_no, 'public address' AS label, match FROM h WHERE o[1] NOT IN (0, 10, 127) AND head NOT IN (169 * 256 + 254, 192 * 256 + 168)
  AND NOT (head BETWEEN 172 * 256 + 16 AND 172 * 256 + 31) AND match NOT IN ('255.255.255.255', '8.8.8.8', '1.1.1.1')""")
def addresses(spark, sf):
    return Q.public_addresses(table(spark, sf, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


_PATHS = """SELECT page_id AS doc_id, html || chr(10) || 'at ' || CASE page_id % 4 WHEN 0 THEN '/home/ubuntu/' WHEN 1 THEN '/home/u' || page_id || '/data' WHEN 2 THEN '/Users/a.b/' ELSE 'x/home/no/' END AS text FROM pages"""


@query("q13_personal_paths", f"""WITH p AS ({_PATHS}), {_LINES.format('p')}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_./])((?:/Users/|/home/)[A-Za-z0-9_.-]+/)', 1)) AS match FROM l)
SELECT doc_id, line_no, 'personal path' AS label, match FROM m WHERE match <> '/home/ubuntu/'""")
def paths(spark, sf):
    """Pages with a line that names a folder; one in four is nobody's, one in four no path of its own."""
    k = F.col("page_id") % 4
    path = (F.when(k == 0, "/home/ubuntu/").when(k == 1, F.concat(F.lit("/home/u"), "page_id", F.lit("/data"))).when(k == 2, "/Users/a.b/").otherwise("x/home/no/"))
    d = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.concat("html", F.lit("\nat "), path).alias("text"))
    return Q.personal_paths(d).withColumn("line_no", F.col("line_no").cast("long"))


_FLAG_NONE = ", ".join(f"0::bigint AS {k}" for k in ("calib_dataset", "act_order", "damp"))


@query("a21_documentation_flags", f"""WITH {CARDS_SQL}, c AS (SELECT k % 4 AS pub, k % 3 AS r, k % 13 = 0 AS stub FROM card)
SELECT 'Pub' || pub AS publisher, count(*) AS n, count(*) FILTER (WHERE r = 0 AND NOT stub) AS lib_named, count(*) FILTER (WHERE r = 0 AND NOT stub) AS lib_version, count(*) FILTER (WHERE r = 0 AND NOT stub) AS num_calib,
  count(*) FILTER (WHERE r = 0 AND NOT stub) AS group_size, count(*) FILTER (WHERE r = 1 AND NOT stub) AS max_seq, {_FLAG_NONE}, count(*) FILTER (WHERE r = 2 OR stub) AS no_recipe, count(*) FILTER (WHERE r = 2 OR stub) AS no_anything FROM c GROUP BY 1""")
def documentation(spark, sf):
    return Q.documentation_flags(cards(spark, sf).withColumn("publisher", F.split("doc_id", "/")[0]), "publisher")


@query("a21_flags_on_documents", "SELECT source, count(*) AS n, " + ", ".join(
    "count(*) FILTER (WHERE regexp_matches(text, '{}')) AS {}".format(p.replace("'", "''"), k) for k, p in Q.FLAGS.items()) + " FROM documents GROUP BY source")
def flags_on_documents(spark, sf):
    return Q.documentation_flags(table(spark, sf, "documents"), "source").drop("no_recipe", "no_anything")


def _readings(docs):
    p = X.parsed_rows(docs, allow_unknown_family=True).select("doc_id", F.explode("emits").alias("e"))
    n = lambda c: F.sum(c.cast("long"))
    return p.groupBy("doc_id").agg(n(F.col("e.before").isNotNull()).alias("usable"), n(F.col("e.orient") == "arith").alias("arith"))


_READ_SQL = """rd0 AS (SELECT c.unit, c.layout, count(*) FILTER (WHERE a > 0 OR layout IN (3, 4)) AS m
  FROM (SELECT unit, layout FROM card WHERE gate IS NULL OR gate = 'unrecognized_family') c JOIN (SELECT model, a FROM cell) x ON x.model = c.unit GROUP BY ALL),
rd AS (SELECT unit, CASE WHEN layout = 5 THEN 0 WHEN layout = 4 THEN 3 * m WHEN layout = 7 THEN m + 1 ELSE m END AS usable FROM rd0),
r AS (SELECT card.k, card.unit, card.layout, coalesce(usable, 0) AS usable, CASE WHEN card.layout IN (0, 1, 2, 6, 7) THEN coalesce(usable, 0) ELSE 0 END AS arith FROM card LEFT JOIN rd USING (unit))"""


@query("a20_paired_evidence_census", f"""WITH {CARDS_SQL}, {_READ_SQL} SELECT 'Pub' || (k % 4) AS publisher, count(*) AS cards_fetched, count(*) FILTER (WHERE usable > 0) AS cards_with_paired_evals, sum(usable)::bigint AS paired_rows_total,
  count(*) FILTER (WHERE arith > 0) AS cards_with_verifiable_evals, sum(arith)::bigint AS arith_verified_rows FROM r GROUP BY 1""")
def paired_census(spark, sf):
    docs = cards(spark, sf)
    return Q.paired_evidence(docs, _readings(docs), "Pub0")


@query("a19_publisher_scorecard", f"""WITH {CARDS_SQL}, {_READ_SQL} SELECT 'Pub' || (k % 4) AS publisher, count(*) AS cards,
  {R("avg((k % 13 <> 0)::int * 2 + (usable > 0)::int * 2 + (k % 13 <> 0 AND layout NOT IN (3, 4))::int + (arith > 0)::int)")} AS mean_score_of_6, {R('100 * avg((k % 13 <> 0)::int)')} AS base_named, {R('100 * avg((usable > 0)::int)')} AS before_reported,
  {R('100 * avg((usable > 0)::int)')} AS after_reported, {R('100 * avg((k % 13 <> 0 AND layout NOT IN (3, 4))::int)')} AS recovery_printed, {R('100 * avg((arith > 0)::int)')} AS recovery_checks,
  {R('100 * avg((k % 13 <> 0)::int)')} AS harness_stated FROM r GROUP BY 1""")
def scorecard(spark, sf):
    docs = cards(spark, sf)
    t = Q.publisher_scorecard(docs, _readings(docs))
    return t.select("publisher", "cards", *[r6(c).alias(c) for c in ("mean_score_of_6", *Q.CHECKS)])


# ------------------------------------------------------------------ sinks


def _out(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("snk1_corpus_and_rejects", f"""WITH {CARDS_SQL} SELECT 'observations' AS part, family, count(*) AS n FROM kept GROUP BY family UNION ALL SELECT 'rejects', '*', count(*) FROM rejected""")
def corpus_sink(spark, sf):
    path = _out(spark, "corpus")
    sinks.write_corpus(*X.extract(cards(spark, sf)), path)
    o = spark.read.parquet(f"{path}/observations").groupBy(F.lit("observations").alias("part"), "family").agg(F.count("*").alias("n"))
    r = spark.read.parquet(f"{path}/rejects").agg(F.lit("rejects").alias("part"), F.lit("*").alias("family"), F.count("*").alias("n"))
    return o.unionByName(r)


@query("snk2_artifact", f"""WITH {OBS_SQL} SELECT scheme, count(*) AS n, min(delta) AS lo, max(delta) AS hi FROM obs GROUP BY scheme""")
def artifact_sink(spark, sf):
    path = _out(spark, "artifact")
    t = obs(spark, sf).groupBy("scheme").agg(F.count("*").alias("n"), F.struct(F.min("delta").alias("lo"), F.max("delta").alias("hi")).alias("range"))
    sinks.write_artifact(t, path)
    back = spark.read.schema(t.schema).json(path)
    return back.select("scheme", "n", "range.lo", "range.hi")


@query("snk3_request_log", """SELECT array_to_string(list_sort(list_distinct(list(event_type))), '|') AS schemes, user_id % 2 = 0 AS moe, count(DISTINCT user_id) > 0 AS logged FROM events GROUP BY user_id, user_id % 2""")
def request_log(spark, sf):
    path = _out(spark, "requests")
    ask = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("schemes"))
    ask = ask.select("schemes", F.lit(None).cast("string").alias("size_band"), (F.col("user_id") % 2 == 0).alias("moe"), F.array(F.lit("")).alias("refused_cells"))
    ok = sinks.log_requests(ask, path)
    return spark.read.parquet(path).select("schemes", "moe", F.lit(ok).alias("logged"))


@query("snk4_census_outputs", f"""WITH {CARDS_SQL} SELECT 'training' AS set, gate IS NULL AS candidate, count(*) AS n FROM card GROUP BY ALL""")
def census_sink(spark, sf):
    path = _out(spark, "census")
    docs = cards(spark, sf)
    rows, rej = X.extract(docs)
    sinks.write_census(X.fates(docs, rows, rej), rej, path)
    t = spark.read.parquet(f"{path}/census_models")
    return t.groupBy("set", (~F.col("fate").rlike("^gate[1-4]")).alias("candidate")).agg(F.count("*").alias("n"))
