"""SQL blocks shared by the DuckDB twins. They read rows directly; none mirrors the Spark plan."""

LEVELS = (("global", "'*'", "'*'"), ("scheme", "scheme", "'*'"), ("stratum", "scheme", "band"))


def r6(x):
    return f"(round({x}, 6) + 0.0)"


def stacked(src, cols, levels=LEVELS):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS level, {s} AS scheme, {b} AS band, {cols} FROM {src}" for name, s, b in levels)


def rank_of(n, alpha=0.10):
    return f"ceil(({n} + 1) * {1 - alpha!r}::double)"


def fit_in_sample(p, src, alpha=0.10, keys=""):
    """CTEs ending in {p}_fit. ``keys`` is an optional comma-joined list of leading key columns."""
    k = keys + ", " if keys else ""
    using = f"USING ({k}level, scheme, band)"
    return f"""{p}_lv AS ({stacked(src, k + 'delta, base_model, family')}),
{p}_m AS (SELECT {k}level, scheme, band, avg(delta) AS mean, count(*) AS n,
   count(DISTINCT base_model) AS n_checkpoints, count(DISTINCT family) AS n_families,
   min(delta) AS worst, max(delta) AS best, quantile_cont(delta, 0.05) AS p05,
   quantile_cont(delta, 0.95) AS p95 FROM {p}_lv GROUP BY ALL),
{p}_r AS (SELECT {k}level, scheme, band, abs(delta - mean) AS resid, n,
   row_number() OVER (PARTITION BY {k}level, scheme, band ORDER BY abs(delta - mean)) AS rn
   FROM {p}_lv JOIN {p}_m {using}),
{p}_h AS (SELECT {k}level, scheme, band, min(resid) FILTER (WHERE rn >= {rank_of('n', alpha)}) AS half_width
   FROM {p}_r GROUP BY ALL),
{p}_fit AS (SELECT *, CASE WHEN level = 'stratum' THEN n >= 20 AND n_checkpoints >= 3
   AND half_width IS NOT NULL ELSE true END AS kept FROM {p}_m JOIN {p}_h {using})"""


def fit_split(p, fit_src, cal_src, variant="widen", alpha=0.10, keys=""):
    """CTEs ending in {p}_model(level, scheme, band, mean, half_width, kept, n_cal); a null
    half_width stands for +inf."""
    k = keys + ", " if keys else ""
    same = "".join(f" AND c.{x} = {{a}}.{x}" for x in keys.split(", ") if x)
    stratum = f"""LEFT JOIN {p}_fit t ON t.level = 'stratum' AND t.kept AND t.scheme = c.scheme
     AND t.band = c.band{same.format(a='t')}""" if variant == "full" else ""
    centre = "coalesce(t.mean, s.mean, g.mean)" if variant == "full" else "coalesce(s.mean, g.mean)"
    ck = "".join(f"c.{x}, " for x in keys.split(", ") if x)
    drop = "AND false" if variant == "scheme" else ""
    return f"""{fit_in_sample(p, fit_src, alpha, keys)},
{p}_c AS (SELECT {ck}c.scheme, c.band, abs(c.delta - {centre}) AS resid FROM {cal_src} c
   JOIN {p}_fit g ON g.level = 'global'{same.format(a='g')}
   LEFT JOIN {p}_fit s ON s.level = 'scheme' AND s.scheme = c.scheme{same.format(a='s')} {stratum}),
{p}_cl AS ({stacked(p + '_c', k + 'resid')}),
{p}_cr AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {k}level, scheme, band) AS n
   FROM {p}_cl WINDOW w AS (PARTITION BY {k}level, scheme, band ORDER BY resid)),
{p}_q AS (SELECT {k}level, scheme, band, max(n) AS n_cal,
   min(resid) FILTER (WHERE rn >= {rank_of('n', alpha)}) AS q FROM {p}_cr GROUP BY ALL),
{p}_model AS (SELECT {k}level, scheme, band, mean, coalesce(n_cal, 0) AS n_cal,
   CASE WHEN coalesce(n_cal, 0) >= 9 THEN q ELSE half_width END AS half_width,
   CASE WHEN level = 'stratum' THEN kept AND coalesce(n_cal, 0) >= 9 AND q IS NOT NULL {drop}
        ELSE true END AS kept
   FROM {p}_fit LEFT JOIN {p}_q USING ({k}level, scheme, band))"""


def predict(p, model, rows, rule="widen", keys=""):
    """CTE {p}_pred: rows plus yhat, half_width (null = inf), lo, hi, level."""
    same = "".join(f" AND o.{x} = {{a}}.{x}" for x in keys.split(", ") if x)
    join = f"""FROM {rows} o JOIN {model} g ON g.level = 'global'{same.format(a='g')}
   LEFT JOIN {model} s ON s.level = 'scheme' AND s.kept AND s.scheme = o.scheme{same.format(a='s')}
   LEFT JOIN {model} t ON t.level = 'stratum' AND t.kept AND t.scheme = o.scheme
      AND t.band = o.band{same.format(a='t')}"""
    base_hw = "CASE WHEN s.mean IS NOT NULL THEN s.half_width ELSE g.half_width END"
    if rule == "fallback":
        yhat = "coalesce(t.mean, s.mean, g.mean)"
        hw = f"CASE WHEN t.mean IS NOT NULL THEN t.half_width ELSE {base_hw} END"
        level = "CASE WHEN t.mean IS NOT NULL THEN 'stratum' WHEN s.mean IS NOT NULL THEN 'scheme' ELSE 'global' END"
    else:
        yhat = "coalesce(s.mean, g.mean)"
        wide = f"coalesce(t.half_width > {base_hw}, false)"
        hw = f"CASE WHEN {wide} THEN t.half_width ELSE {base_hw} END"
        level = f"CASE WHEN {wide} THEN 'stratum-widened' ELSE 'scheme' END"
    return f"""{p}_p0 AS (SELECT o.*, {yhat} AS yhat, {hw} AS half_width, {level} AS level {join}),
{p}_pred AS (SELECT *, yhat - half_width AS lo, yhat + half_width AS hi,
   coalesce(delta >= yhat - half_width - 1e-9 AND delta <= yhat + half_width + 1e-9, true) AS ok,
   coalesce(delta >= yhat - half_width - 1e-9, true) AS ok_one FROM {p}_p0)"""


PAIR_FOLDS = """fams AS (SELECT DISTINCT family AS f FROM obs),
pf AS (SELECT a.f AS test_family, b.f AS cal_family FROM fams a JOIN fams b ON a.f <> b.f),
fold_ok AS (SELECT test_family, cal_family FROM pf JOIN obs ON family <> test_family
   GROUP BY ALL HAVING count(*) FILTER (WHERE family = cal_family) >= 19
     AND count(*) FILTER (WHERE family <> cal_family) >= {min_train})"""


def pair_rows(p, folds="fold_ok", src="obs"):
    return f"""{p}_f AS (SELECT test_family, cal_family, o.* FROM {folds} JOIN {src} o
   ON o.family <> test_family AND o.family <> cal_family),
{p}_k AS (SELECT test_family, cal_family, o.* FROM {folds} JOIN {src} o ON o.family = cal_family),
{p}_t AS (SELECT test_family, cal_family, o.* FROM {folds} JOIN {src} o ON o.family = test_family)"""


def scored_pairs():
    """CTEs ending in y_pred: the widen-only band of every (test, calibration) family pair."""
    keys = "test_family, cal_family"
    return (f"{PAIR_FOLDS.format(min_train=50)}, {pair_rows('p')}, "
            f"{fit_split('x', 'p_f', 'p_k', 'widen', keys=keys)}, "
            f"{predict('y', 'x_model', 'p_t', 'widen', keys=keys)}")


def mondrian(p, train, cal, test, keys, alpha=0.10, grouped=True, noise=None, eps="1e-9"):
    """CTEs ending in {p}_pred: treatment-mean centre, per-treatment quantile with back-off."""
    c_s = "".join(f" AND s.{x} = c.{x}" for x in keys.split(", "))
    c_g = " AND ".join(f"g.{x} = c.{x}" for x in keys.split(", "))
    kc = ", ".join(f"c.{x}" for x in keys.split(", "))
    div = f" / ({noise})" if noise else ""
    mul = f" * ({noise})" if noise else ""
    q = "m.q" if not grouped else "coalesce(q.q, m.q)"
    back = "false" if not grouped else "q.q IS NULL"
    return f"""{p}_g AS (SELECT {keys}, avg(delta) AS mean FROM {train} GROUP BY ALL),
{p}_s AS (SELECT {keys}, scheme, avg(delta) AS mean FROM {train} GROUP BY ALL),
{p}_sc AS (SELECT {kc}, c.scheme, abs(c.delta - coalesce(s.mean, g.mean)){div} AS score FROM {cal} c
   JOIN {p}_g g ON {c_g} LEFT JOIN {p}_s s ON s.scheme = c.scheme{c_s}),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, scheme ORDER BY score) AS rs,
   count(*) OVER (PARTITION BY {keys}, scheme) AS ns, row_number() OVER (PARTITION BY {keys} ORDER BY score) AS ra,
   count(*) OVER (PARTITION BY {keys}) AS na FROM {p}_sc),
{p}_q AS (SELECT {keys}, scheme, min(score) FILTER (WHERE rs >= {rank_of('ns', alpha)}) AS q FROM {p}_r GROUP BY ALL),
{p}_qm AS (SELECT {keys}, min(score) FILTER (WHERE ra >= {rank_of('na', alpha)}) AS q FROM {p}_r GROUP BY ALL),
{p}_p0 AS (SELECT c.*, coalesce(s.mean, g.mean) AS yhat, {q}{mul} AS half_width, {back} AS backed_off
   FROM {test} c JOIN {p}_g g ON {c_g} LEFT JOIN {p}_s s ON s.scheme = c.scheme{c_s}
   JOIN {p}_qm m ON {c_g.replace('g.', 'm.')}
   LEFT JOIN {p}_q q ON q.scheme = c.scheme{c_s.replace('s.', 'q.')}),
{p}_pred AS (SELECT *, yhat - half_width AS lo, yhat + half_width AS hi,
   coalesce(delta >= yhat - half_width - {eps} AND delta <= yhat + half_width + {eps}, true) AS covered FROM {p}_p0)"""


def evaluate(src, keys, fold):
    """SELECT of interval quality per ``keys``; ``fold`` is the fold label expression."""
    return f"""SELECT * FROM (SELECT {keys}, count(*) AS n_rows, {r6('avg(covered::int)')} AS coverage,
   {r6('avg(half_width)')} AS mean_half_width, {r6('quantile_cont(half_width, 0.5)')} AS median_half_width,
   {r6('avg(abs(delta - yhat))')} AS mae, {r6('sqrt(avg((delta - yhat) ** 2))')} AS rmse,
   {r6('1 - sum((delta - yhat) ** 2) / (var_pop(delta) * count(*))')} AS r2,
   {r6('avg((coalesce(lo > 0, false) OR coalesce(hi < 0, false))::int)')} AS share_excluding_zero,
   {r6('avg((half_width IS NULL)::int)')} AS share_infinite, {r6('avg(backed_off::int)')} AS share_backoff
   FROM {src} GROUP BY ALL)
JOIN (SELECT {keys}, count(*) AS n_folds, {r6('avg(c)')} AS mean_per_fold_coverage, {r6('min(c)')} AS worst_fold_coverage,
   arg_min(fold, (c, fold)) AS worst_fold FROM
   (SELECT {keys}, {fold} AS fold, avg(covered::int) AS c FROM {src} GROUP BY ALL) GROUP BY ALL) USING ({keys})"""


COMPOSITIONS = """comp0 AS (
  WITH RECURSIVE c(k, i, rest, counts) AS (
    SELECT k, 0, k, []::INT[] FROM range(1, 9) t(k)
    UNION ALL SELECT k, i + 1, rest - v, list_append(counts, v::INT) FROM c, range(0, 9) r(v)
    WHERE i < k AND v <= rest AND (i < k - 1 OR v = rest))
  SELECT k, counts FROM c WHERE i = k),
comp AS (SELECT k, counts, factorial(k::INT)::double / list_product(list_transform(counts, lambda x: factorial(x)::double))
   / pow(k, k) AS prob FROM comp0)"""


def exact_bootstrap(p, clusters, keys, lo=0.05, hi=0.95):
    """CTEs ending in {p}_exact(keys, k, boot_lo, boot_hi) from clusters(keys, base_model, ok, n)."""
    return f"""{COMPOSITIONS},
{p}_a AS (SELECT {keys}, count(*) AS k, list(ok::double ORDER BY base_model) AS oks, list(n::double ORDER BY base_model) AS ns
   FROM {clusters} GROUP BY ALL HAVING count(*) <= 8),
{p}_v AS (SELECT {keys}, a.k, prob, list_sum(list_transform(range(1, a.k + 1), lambda i: counts[i] * oks[i]))
   / list_sum(list_transform(range(1, a.k + 1), lambda i: counts[i] * ns[i])) AS v FROM {p}_a a JOIN comp c ON c.k = a.k),
{p}_c AS (SELECT *, sum(prob) OVER (PARTITION BY {keys} ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum FROM {p}_v),
{p}_exact AS (SELECT {keys}, max(k) AS k, 100 * coalesce(min(v) FILTER (WHERE cum >= {lo} - 1e-12), max(v)) AS boot_lo,
   100 * coalesce(min(v) FILTER (WHERE cum >= {hi} - 1e-12), max(v)) AS boot_hi FROM {p}_c GROUP BY ALL)"""


def sandwich(p, clusters, keys):
    return f"""{p}_p AS (SELECT {keys}, count(*) AS k, sum(ok) / sum(n) AS p, sum(n) AS nn FROM {clusters} GROUP BY ALL),
{p}_rob AS (SELECT {keys}, k, p, nn, CASE WHEN k > 1 THEN sqrt(k / (k - 1) * dev) / nn END AS se,
   sqrt(p * (1 - p) / nn) AS se_naive FROM (SELECT {keys}, k, p, nn, sum((ok - p * n) ** 2) AS dev
   FROM {clusters} JOIN {p}_p USING ({keys}) GROUP BY ALL))"""


def evidence():
    """CTEs ending in rec(scheme, band, ..., boot90_lo, boot90_hi, state) from y_pred."""
    cols = """count(*) AS scored_pairs, count(DISTINCT obs_id) AS distinct_rows,
      count(DISTINCT base_model) AS distinct_checkpoints, count(DISTINCT family) AS distinct_families,
      avg(ok::int) AS coverage, avg(ok_one::int) AS coverage_one_sided"""
    return f"""z AS (SELECT *, '*' AS star FROM y_pred),
rec0 AS (SELECT scheme, star AS band, {cols} FROM z GROUP BY scheme, star UNION ALL SELECT scheme, band, {cols} FROM z GROUP BY scheme, band),
cl AS (SELECT scheme, star AS band, base_model, sum(ok_one::int) AS ok, count(*) AS n FROM z GROUP BY scheme, star, base_model
   UNION ALL SELECT scheme, band, base_model, sum(ok_one::int), count(*) FROM z GROUP BY scheme, band, base_model),
{exact_bootstrap('b', 'cl', 'scheme, band')}, many AS (SELECT * FROM cl QUALIFY count(*) OVER (PARTITION BY scheme, band) > 8),
{draws('w', 'many', 'scheme, band', ['ok', 'n'], "CASE WHEN band = '*' THEN 200000 ELSE 20000 END", most=200_000)},
{draw_bounds('r', 'w_d', 'scheme, band', '100.0::DOUBLE * ok / n', 0.05, 0.95)},
rec AS (SELECT rec0.*, coalesce(e.boot_lo, r.boot_lo) AS boot90_lo,
   coalesce(e.boot_hi, r.boot_hi) AS boot90_hi,
   CASE WHEN distinct_checkpoints < 3 THEN 'insufficient_evidence' WHEN boot90_lo IS NULL OR boot90_hi IS NULL
     THEN 'insufficient_evidence' WHEN boot90_lo < 85 AND 85 < boot90_hi THEN 'insufficient_evidence'
     WHEN coverage_one_sided < 0.85 THEN 'refused' ELSE 'trusted' END AS state
   FROM rec0 LEFT JOIN b_exact e USING (scheme, band) LEFT JOIN r_b r USING (scheme, band))"""


def _md5(text):
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def draws(name, src, keys, sums, n, seed=0, cluster="base_model", most=None):
    """CTEs ending in {name}_d(keys, draw, sums): clusters of ``src`` drawn with replacement n times (a number,
    or an expression of the keys that is at most ``most``). Pick j of a draw is its cubic at j modulo a prime."""
    added = ", ".join(f"sum({s}) AS {s}" for s in sums)
    m, prime = f"md5('{seed}:' || draw)", 2**31 - 1
    a, b, c, d = (f"('0x' || substr({m}, {i}, 8))::BIGINT % {prime} AS c{i}" for i in (1, 9, 17, 25))
    order = f"substr(md5({cluster}::VARCHAR), 1, 5), {cluster}"
    return f"""{name}_i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {keys}, {order}) - 1 AS r FROM {src}),
{name}_g AS (SELECT {keys}, min(r) AS off, count(*) AS k FROM {name}_i GROUP BY {keys}),
{name}_h AS MATERIALIZED (SELECT draw, {a}, {b}, {c}, {d} FROM range({most or n}) t(draw)),
{name}_p AS MATERIALIZED (SELECT {keys}, off, k, r - off AS j FROM {name}_i JOIN {name}_g USING ({keys})),
{name}_q AS (SELECT off, draw, off + (((c1 * j + c9) % {prime} * j + c17) % {prime} * j + c25) % {prime} % k AS r FROM {name}_h, {name}_p WHERE draw < {n}),
{name}_s AS (SELECT off, draw, {added} FROM {name}_q JOIN (SELECT r, {', '.join(sums)} FROM {name}_i) USING (r) GROUP BY off, draw),
{name}_d AS (SELECT {keys}, draw, {', '.join(sums)} FROM {name}_s JOIN {name}_g USING (off))"""


def free_draws(name, src, keys, sums, n, seed=0, cluster="base_model"):
    """As ``draws``, every pick an MD5 of its own: picks of a draw are independent, not only any four of them."""
    added = ", ".join(f"sum({s}) AS {s}" for s in sums)
    return f"""{name}_i AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY substr(md5({cluster}::VARCHAR), 1, 5), {cluster}) - 1 AS idx,
  count(*) OVER (PARTITION BY {keys}) AS k FROM {src}),
{name}_p AS (SELECT {keys}, k, idx AS j, unnest(range({n})) AS draw FROM {name}_i),
{name}_q AS (SELECT {keys}, draw, {_md5(f"'{seed}:' || draw || ':' || j")} % k AS idx FROM {name}_p),
{name}_d AS (SELECT {keys}, draw, {added} FROM {name}_q JOIN {name}_i USING ({keys}, idx) GROUP BY {keys}, draw)"""


def draw_bounds(name, src, keys, value, lo, hi):
    """CTE {name}_b(keys, boot_lo, boot_hi): order statistics of ``value`` over the draws."""
    return f"""{name}_o AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS i,
  count(*) OVER (PARTITION BY {keys}) AS m FROM {src}),
{name}_b AS (SELECT {keys}, max(v) FILTER (WHERE i = floor({lo} * (m - 1))) AS boot_lo, max(v) FILTER (WHERE i = ceil({hi} * (m - 1))) AS boot_hi
  FROM {name}_o GROUP BY {keys})"""


def sampled_calibration(table="obs", key="base_model", seed=0):
    """The clusters in order of their seeded hash, the first third of them for calibration."""
    h = _md5(f"'{seed}:' || {key}")
    return f"""SELECT {key}, row_number() OVER (ORDER BY {h}, {key}) <= round_even((SELECT count(DISTINCT {key}) FROM {table}) * (1.0::DOUBLE / 3.0), 0) AS is_cal
FROM (SELECT DISTINCT {key} FROM {table})"""


# CTEs ending in e: absolute errors of the mean predictors, each fitted without the row's family.
LOFO = """fams AS (SELECT DISTINCT family AS f FROM obs), g AS (SELECT f, avg(delta) AS gm FROM fams JOIN obs ON family <> f GROUP BY f),
sm AS (SELECT f, scheme, avg(delta) AS m FROM fams JOIN obs ON family <> f GROUP BY ALL), bm AS (SELECT f, benchmark, avg(delta) AS m FROM fams JOIN obs ON family <> f GROUP BY ALL),
sb AS (SELECT f, scheme, benchmark, avg(delta) AS m FROM fams JOIN obs ON family <> f GROUP BY ALL),
e AS (SELECT o.family, o.base_model, abs(delta - gm) AS e_global, abs(delta - coalesce(sm.m, gm)) AS e_scheme, abs(delta - coalesce(bm.m, gm)) AS e_task, abs(delta - coalesce(sb.m, sm.m, gm)) AS e_scheme_task
  FROM obs o JOIN g ON g.f = o.family LEFT JOIN sm ON sm.f = o.family AND sm.scheme = o.scheme LEFT JOIN bm ON bm.f = o.family AND bm.benchmark = o.benchmark
  LEFT JOIN sb ON sb.f = o.family AND sb.scheme = o.scheme AND sb.benchmark = o.benchmark)"""
