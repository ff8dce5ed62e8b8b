"""Personal data in documents by weakly supervised labelers, with DataFrame functions only.

Four base kinds (email, ip, card, phone) are defined by pattern and check and always stay. Further
candidates, long numbers and long key-like strings, are judged by labelers that vote for, against or not
at all: patterns, gazetteers (issuer prefixes, words) and context. Expectation-maximisation estimates how
reliable every labeler is from the votes alone, on the counts of the vote patterns (at most 3 to the
number of labelers rows). The posteriors then train a naive Bayes span classifier on the span's shape and
surroundings, whose weighted sums are one grouped aggregate; its decision adds spans.

Texts are scanned once; spans, not texts, are written. Repeated groups in the patterns are possessive
and candidate starts are anchored, so a long run of one character neither recurses nor is scanned twice.

Defined cases: a null or empty text has no spans; matches that fail their check are dropped and not
retried; candidates that overlap a base span are dropped; without candidates nothing is added; rows are
judged one by one; an empty table gives no rows; extra columns are ignored by ``find`` and kept by
``redact``.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairmeter.llm.common import read, stage

KINDS = ["email", "ip", "card", "phone", "account", "secret"]
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_WEAK = "array<struct<start:int,kind:int,end:int,match:string,before:string,after:string>>"

# The base patterns, written so that no repetition gives back what it took.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]?+[0-9])++(?![0-9A-Za-z])"
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"

# Words of the gazetteers and contexts.
CONTACT_WORDS = r"(?:call|tel|phone|fax|mobile|cell|whatsapp|contact|reach|dial|appeler|anrufen|telefon|llamar)\W*$"
ACCOUNT_WORDS = r"(?:card|visa|mastercard|amex|account|acct|iban|ssn|passport|licen[cs]e|konto|carte|tarjeta|cuenta)(?:\W|no\.?|number|nr\.?)*$"
SECRET_WORDS = r"(?:token|secret|password|passwd|api[_ -]?key|key|auth|bearer|credential)\W*$"
OTHER_WORDS = r"(?:isbn|issn|doi|order|ticket|issue|version|page|figure|table|commit|sha|md5|hash|checksum|[$#€£%=/])\W*$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda k: F.substring(back, k + 1, F.lit(1)).cast("int") * (k % 2 + 1)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, k: (a + F.when(value(k) > 9, value(k) - 9).otherwise(value(k))).cast("int"))
    return total % 10 == 0


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))


def _is_ip(m: Column) -> Column:
    def small(part):
        p = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False))
    return F.forall(F.split(m, r"\."), small)


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


#: kind, pattern, check, what a text must hold for the pattern to be tried at all
BASE = [(0, EMAIL, lambda m: F.lit(True), lambda t: F.contains(t, F.lit("@"))),
        (1, IP, _is_ip, lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]")),
        (2, CARD, _is_card, lambda t: t.rlike("[0-9]")),
        (3, PHONE, _is_phone, lambda t: F.contains(t, F.lit("+")))]


def _matches(text: Column, pattern: str, ok, kind: int, guard: Column, weak: bool = False) -> Column:
    """Spans of the matches that pass, from the matches and the texts between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(_WEAK if weak else _SPAN)
    parts = [gaps, hits] + ([F.slice(gaps, F.lit(2), F.greatest(F.lit(1), F.size(gaps)))] if weak else [])

    def step(a, x):
        start = a["pos"] + F.length(x["0"])
        end = start + F.coalesce(F.length(x["1"]), F.lit(0))
        fields = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")]
        if weak:
            fields += [x["1"].alias("match"), F.lower(F.right(x["0"], F.lit(24))).alias("before"), F.left(F.coalesce(x["2"], F.lit("")), F.lit(8)).alias("after")]
        more = F.concat(a["spans"], F.array(F.struct(*fields)))
        return F.struct(end.alias("pos"), F.when(x["1"].isNotNull() & ok(x["1"]), more).otherwise(a["spans"]).alias("spans"))

    found = F.aggregate(F.arrays_zip(*parts), F.struct(F.lit(0).alias("pos"), empty.alias("spans")), step, lambda a: a["spans"])
    return F.when(guard, found).otherwise(empty)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans of every kind (b0 to b3) and the candidates (weak) of its text."""
    t = F.coalesce("text", F.lit(""))
    out = docs.withColumns({f"b{k}": _matches(t, p, ok, k, guard(t)) for k, p, ok, guard in BASE})
    number = _matches(t, NUMBER, lambda m: F.length(_digits(m)).between(7, 19), 4, t.rlike("[0-9][ ().-]?[0-9]"), True)
    secret = _matches(t, SECRET, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 5, t.rlike("[0-9]"), True)
    out = out.withColumn("base", F.flatten(F.array("b0", "b1", "b2", "b3"))).withColumn("all_weak", F.concat(number, secret))
    free = F.filter("all_weak", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return out.withColumn("weak", free).drop("all_weak")


def _vote(yes: Column, no: Column = None) -> Column:
    out = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (out.when(F.coalesce(no, F.lit(False)), -1) if no is not None else out).otherwise(0)


def votes(c: Column) -> list:
    """The labelers' votes on a candidate: 1 for personal, -1 against, 0 for none."""
    m, before, digits = c["match"], c["before"], _digits(c["match"])
    n, secret = F.length(digits), c["kind"] == 5
    return [
        _vote(~secret & m.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"),
              ~secret & m.rlike(r"^[0-9]{4}[ .-][0-9]{1,2}[ .-][0-9]{1,2}$")),                # formats: dates are not personal
        _vote(secret & m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | secret & m.rlike("^(?:AKIA|ghp_|sk_|xox)")),  # key formats
        _vote(~secret & digits.rlike(ISSUERS) & n.between(13, 19), ~secret & n.between(7, 8)),   # issuer prefixes
        _vote(~secret & before.rlike(CONTACT_WORDS)),
        _vote(~secret & before.rlike(ACCOUNT_WORDS)),
        _vote(secret & before.rlike(SECRET_WORDS)),
        _vote(F.lit(False), before.rlike(OTHER_WORDS) & ~before.rlike(SECRET_WORDS)),
        _vote(F.lit(False), ~secret & n.between(9, 19) & ~m.rlike("[^0-9]") & ~digits.rlike(ISSUERS)),  # a bare number of no issuer
    ]


def features(c: Column) -> list:
    """What the span classifier sees: shape, length and surroundings, as short strings."""
    m = c["match"]
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A"), 1, 8)
    word = F.regexp_extract(c["before"], r"([a-z]{2,})\W*$", 1)
    kind = F.when(c["before"].rlike(SECRET_WORDS), "secret").when(c["before"].rlike(ACCOUNT_WORDS), "account").when(
        c["before"].rlike(CONTACT_WORDS), "contact").when(c["before"].rlike(OTHER_WORDS), "other").when(word == "", "none").otherwise("word")
    return [c["kind"].cast("string"), shape, F.least(F.length(m), F.lit(40)).cast("string"), kind,
            F.regexp_replace(F.regexp_replace(F.right(c["before"], F.lit(1)), "[a-z]", "a"), "[0-9]", "9"),
            F.regexp_replace(F.regexp_replace(F.left(c["after"], F.lit(1)), "[A-Za-z]", "a"), "[0-9]", "9")]


def reliabilities(patterns: list, rounds: int = 40):
    """EM over (votes, count): prior and, per labeler, log P(vote | personal) / P(vote | not) by vote.

    Labelers start at 0.8 of their votes right, and that belief stays as pseudo-counts: with few or
    one-sided votes the estimates stay near it.
    """
    n = len(patterns[0][0]) if patterns else 0
    values = (-1, 0, 1)
    start = {1: (0.15, 0.05, 0.8), 0: (0.8, 0.05, 0.15)}
    prior, table = 0.3, [{y: dict(zip(values, start[y])) for y in (0, 1)} for _ in range(n)]
    for _ in range(rounds if patterns else 0):
        sums = [{y: {v: 4.0 * start[y][values.index(v)] for v in values} for y in (0, 1)} for _ in range(n)]
        mass = [7.0, 3.0]
        for vote, count in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(table, vote) if v)
            p = 1 / (1 + math.exp(-max(-50, min(50, odds))))
            for y, w in ((1, p * count), (0, (1 - p) * count)):
                mass[y] += w
                for s, v in zip(sums, vote):
                    s[y][v] += w
        prior = mass[1] / sum(mass)
        # given that it votes, a labeler errs at some rate; how often it votes says nothing
        for t, s in zip(table, sums):
            for y in (0, 1):
                cast = s[y][-1] + s[y][1]
                t[y] = {-1: s[y][-1] / cast, 0: 1.0, 1: s[y][1] / cast}
    return prior, [{v: math.log(t[1][v] / t[0][v]) if v else 0.0 for v in values} for t in table]


def _lookup(value: Column, table: dict) -> Column:
    """The table's number for a value, 0 for values it lacks."""
    flat = [x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*flat), value), F.lit(0.0)) if flat else F.lit(0.0)


def fit(scanned: DataFrame) -> dict:
    """The span classifier from the candidates of ``scanned(weak)``: bias and weights by feature value.

    The vote patterns and the feature values of the six features reach the driver; both are bounded by
    their definition, not by the corpus.
    """
    c = stage(scanned.select(F.explode("weak").alias("c")).select(F.array(*votes(F.col("c"))).alias("v"), F.array(*features(F.col("c"))).alias("f")))
    patterns = [(tuple(r.v), r.n) for r in c.groupBy("v").agg(F.count("*").alias("n")).collect()]
    prior, odds = reliabilities(sorted(patterns))
    if not patterns:
        return {"bias": -1.0, "weights": [{} for _ in range(6)]}
    total = F.lit(math.log(prior / (1 - prior)))
    for k, table in enumerate(odds):
        total = total + F.when(F.col("v")[k] == 1, F.lit(table[1])).when(F.col("v")[k] == -1, F.lit(table[-1])).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-total))
    soft = c.select(p.alias("p"), F.posexplode("f").alias("k", "value")).groupBy("k", "value").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes, no = (sum(r[i] for r in soft if r.k == 0) for i in ("yes", "no"))
    weights = [{} for _ in range(6)]
    for r in soft:
        weights[r.k][r.value] = math.log((r.yes + 0.5) / (yes + 1) / ((r.no + 0.5) / (no + 1)))
    return {"bias": math.log((yes + 0.5) / (no + 0.5)), "weights": weights}


def accepted(weak: str, model: dict) -> Column:
    """The candidates that the classifier calls personal, as spans."""
    def personal(c):
        score = F.lit(model["bias"])
        for f, table in zip(features(c), model["weights"]):
            score = score + _lookup(f, table)
        return score > 0
    return F.transform(F.filter(weak, personal), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans of every document."""
    rows = stage(scan(docs.select("doc_id", "text")).drop("text"))
    model = fit(rows)
    counts = [F.size(f"b{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.concat("base", accepted("weak", model))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; overlapping spans are
    replaced together, under the name of the first."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scanned = scan(d.withColumn("text", F.col("row.text")))
    model = fit(stage(scanned.where(F.size("weak") > 0).select("weak")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.concat("base", accepted("weak", model)))
    text = F.col("row.text")

    def step(a, s):
        part = F.when(s["start"] >= a["pos"], F.concat(F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.get(names, s["kind"]))).otherwise("")
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.concat(a["out"], part).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                        lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    rows = scanned.withColumn("spans", spans).select("row", F.when(F.size("spans") > 0, clean).otherwise(text).alias("clean"))
    return rows.select(*[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
