"""Divergence of sources: which sources of a language use its vocabulary differently, and in which terms.

A language keeps the terms that occur in at least three of its documents. The kept terms, sorted, are cut
into blocks, and every block becomes a minimal acyclic transducer: an automaton that shares equal endings
and whose arcs carry numbers, so that the numbers on a term's path add up to its place in the sorted
vocabulary (its ordinal). The texts are then read again and their words run through the transducers; a
word that no path accepts is not kept. Only (language, source, ordinal, count) is shuffled, never a word,
and ties between terms are broken by ordinal, which is the order of their UTF-8 bytes.

The transducers travel to the tasks in rounds of at most ``MOST_BYTES``; a round reads the documents of
its languages only. A vocabulary that fits into one round (about ten million terms) costs one scan, a
larger one costs a scan per ``MOST_BYTES``, and the result is the same.

The chi-square-like distance of two sources is summed over all kept terms without visiting the terms a
source lacks: those have one probability per source, so their share comes from a histogram of counts, and
only terms that both sources hold are compared one by one, in blocks of bounded size.

Defined cases: null text, language and source count as empty strings; every row is a document, so repeated
rows are counted as often as they occur; a text of any length is read whole, in segments cut between
words; a group without kept terms has count 0 for each; a language without kept terms has pair values 0
and no terms; an empty table gives no rows; extra columns are ignored.
"""

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairmeter.llm.common import batches_by_bytes, ranked, read, stage

LEAST_DOCUMENTS, SCALE, TOP = 3, 10**9, 200
#: Terms of one transducer, bytes of transducers sent to the tasks at once, terms a task counts before it
#: hands its counts on, and cells (terms x sources) that one comparison holds.
BLOCK, MOST_BYTES, HELD, CELLS = 50_000, 64 << 20, 1_000_000, 1 << 20

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text, segment: int = 1 << 20):
    """The terms of a text as UTF-8 bytes, A to Z in lower case, a list per segment."""
    data = (text or "").encode("utf-8", "replace").translate(_TERM)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + segment)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def prepared(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), empty).alias("source"), F.coalesce("text", empty).alias("text"))


def vocabulary(rows: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, ordinal) of every kept term; ordinals count from 0 in each language."""
    def count(frames):
        held, size = {}, 0
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                seen = held.setdefault(lang, Counter())
                before = len(seen)
                seen.update(set().union(*words(text)))
                size += len(seen) - before
                if size > HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    def flush(held):
        for lang, seen in held.items():
            if seen:
                yield pd.DataFrame({"lang": lang, "term": [t.decode("utf-8") for t in seen], "n": np.fromiter(seen.values(), np.int64, len(seen))})

    kept = (rows.select("lang", "text").mapInPandas(count, "lang string, term string, n long")
                .groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n"))
    placed = stage(ranked(kept, ["lang", "term"]))
    first = placed.groupBy("lang").agg(F.min("rank").alias("first"))
    return placed.join(first, "lang").select("lang", "term", (F.col("rank") - F.col("first")).alias("ordinal"))


class Transducer:
    """Maps the words it was built from, given sorted and distinct, to their places 0, 1, 2, ..."""

    def __init__(self, keys, targets, weights, final, depth):
        self.keys, self.targets, self.weights, self.final, self.depth = keys, targets, weights, final, depth

    @classmethod
    def build(cls, terms):
        known, states, open_nodes, last = {}, [], [[False, []]], b""

        def close(depth):
            # nodes below ``depth`` of the last word take no more arcs: each becomes the state equal to it
            while len(open_nodes) - 1 > depth:
                node = open_nodes.pop()
                form = (node[0], tuple(node[1]))
                state = known.get(form)
                if state is None:
                    state = known[form] = len(states)
                    states.append(form)
                open_nodes[-1][1].append((last[len(open_nodes) - 1], state))

        for term in terms:
            shared, most = 0, min(len(term), len(last))
            while shared < most and term[shared] == last[shared]:
                shared += 1
            close(shared)
            open_nodes.extend([False, []] for _ in range(len(term) - shared))
            open_nodes[-1][0] = True
            last = term
        close(0)
        states.append((open_nodes[0][0], tuple(open_nodes[0][1])))
        accepted = []
        keys, targets, weights = [], [], []
        for number, (final, arcs) in enumerate(states):  # the targets of a state come before it
            total = int(final)
            for byte, target in arcs:
                keys.append(number << 8 | byte)
                targets.append(target)
                weights.append(total)
                total += accepted[target]
            accepted.append(total)
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(weights, np.int32),
                   np.array([s[0] for s in states], bool), max(map(len, terms), default=0))

    def ordinals(self, terms) -> np.ndarray:
        """The place of every term, -1 for one that is not among the words."""
        n = len(terms)
        length = np.fromiter(map(len, terms), np.int64, n)
        start = np.cumsum(length) - length
        text = np.frombuffer(b"".join(terms), np.uint8)
        state, place = np.full(n, len(self.final) - 1, np.int64), np.zeros(n, np.int64)
        going, out = np.flatnonzero(length <= self.depth), np.full(n, -1, np.int64)
        for k in range(self.depth + 1):
            ends = length[going] == k
            done = going[ends]
            done = done[self.final[state[done]]]
            out[done] = place[done]
            going = going[~ends]
            if not len(going) or not len(self.keys):
                break
            wanted = state[going] << 8 | text[start[going] + k]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            going, at = going[found], at[found]
            place[going] += self.weights[at]
            state[going] = self.targets[at]
        return out


_PARTS = {"keys": np.int64, "targets": np.int32, "weights": np.int32, "final": np.bool_}


def transducers(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of a language's sorted terms: its first ordinal, its first term, and the arrays of
    its transducer."""
    def build(key, pdf):
        pdf = pdf.sort_values("ordinal")
        terms = [t.encode("utf-8") for t in pdf["term"]]
        t = Transducer.build(terms)
        parts = {name: getattr(t, name).tobytes() for name in _PARTS}
        return pd.DataFrame([{"lang": key[0], "first": int(pdf["ordinal"].iloc[0]), "low": terms[0], "depth": t.depth,
                              "n_bytes": sum(map(len, parts.values())), **parts}])

    schema = "lang string, first long, low binary, depth long, n_bytes long, " + ", ".join(f"{p} binary" for p in _PARTS)
    return vocab.groupBy("lang", F.floor(F.col("ordinal") / block).alias("block")).applyInPandas(build, schema)


def recount(rows: DataFrame, machines: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): how often every kept term occurs in every group that holds it."""
    spark, out, ready = rows.sparkSession, None, {}
    rounds, size = [], most_bytes
    for lang, first, n in sorted(map(tuple, machines.select("lang", "first", "n_bytes").collect())):
        if size + n > most_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append((lang, first))
        size += n

    def run(sent, frames):
        if sent.value is not ready.get("of"):
            blocks = {}
            for r in sent.value:
                parts = {p: np.frombuffer(r[p], t) for p, t in _PARTS.items()}
                blocks.setdefault(r["lang"], []).append((bytes(r["low"]), r["first"], Transducer(**parts, depth=r["depth"])))
            ready["of"], ready["blocks"] = sent.value, blocks
        blocks, held, size = ready["blocks"], {}, 0
        for f in batches_by_bytes(frames, "text", 8 << 20):
            groups = {}
            for lang, source, text in zip(f["lang"], f["source"], f["text"]):
                seen = groups.setdefault(lang, {}).setdefault(source, Counter())
                for part in words(text):
                    seen.update(part)
            for lang, by_source in groups.items():
                terms = sorted(set().union(*by_source.values()))
                found = np.full(len(terms), -1, np.int64)
                edges = [bisect_left(terms, low) for low, _, _ in blocks[lang]] + [len(terms)]
                for a, b, (_, first, machine) in zip(edges, edges[1:], blocks[lang]):
                    place = machine.ordinals(terms[a:b])
                    found[a:b] = np.where(place < 0, -1, place + first)
                ordinal = dict(zip(terms, found.tolist()))
                for source, seen in by_source.items():
                    at = np.fromiter(map(ordinal.__getitem__, seen), np.int64, len(seen))
                    n = np.fromiter(seen.values(), np.int64, len(seen))
                    held.setdefault((lang, source), []).append((at[at >= 0], n[at >= 0]))
                    size += len(at)
            if size > 2 * HELD:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held):
        for (lang, source), parts in held.items():
            at, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(at), np.int64)
            np.add.at(n, back, np.concatenate([p[1] for p in parts]))
            if len(at):
                yield pd.DataFrame({"lang": lang, "source": source, "ordinal": at, "n": n})

    for chosen in rounds:
        langs = sorted({lang for lang, _ in chosen})
        (a, low), (b, high) = chosen[0], chosen[-1]
        inside = ((F.col("lang") > a) | (F.col("lang") == a) & (F.col("first") >= low)) & ((F.col("lang") < b) | (F.col("lang") == b) & (F.col("first") <= high))
        sent = spark.sparkContext.broadcast(sorted((r.asDict() for r in machines.where(inside).collect()), key=lambda r: (r["lang"], r["first"])))
        part = (rows.where(F.col("lang").isin(langs))
                    .mapInPandas(lambda frames, sent=sent: run(sent, frames), "lang string, source string, ordinal long, n long"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count, total, terms, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + terms)) in 64 bits: the quotient is made three digits at a time."""
    below = np.asarray(total, np.int64) + np.asarray(terms, np.int64)
    rest, out = np.asarray(count, np.int64) + 1, 0
    while scale > 1:
        rest = rest * 1000
        out, rest, scale = out * 1000 + rest // below, rest % below, scale // 1000
    return out + 1


def distance(p, q) -> np.ndarray:
    d = p - q
    return d * d // q


def compare(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks of terms: (lang, source, item, ordinal, value) with ``item`` another source and ``value`` what
    the terms that both hold add to their distance, or with ``ordinal`` one of the group's first terms."""
    per_lang = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.count("*"))).cast("long").alias("span"), F.sum("total").alias("lang_total"))
    rows = counts.join(groups, ["lang", "source"]).join(per_lang, "lang")

    def block(key, pdf):
        sources, s = np.unique(pdf["source"].to_numpy(dtype=object), return_inverse=True)
        ordinals, t = np.unique(pdf["ordinal"].to_numpy(), return_inverse=True)
        count = np.zeros((len(ordinals), len(sources)), np.int64)
        count[t, s] = pdf["n"]
        total = np.zeros(len(sources), np.int64)
        total[s] = pdf["total"]
        terms = int(pdf["terms"].iloc[0])
        p, none, held = share(count, total, terms), share(0, total, terms), count > 0
        q = share(count.sum(axis=1), int(pdf["lang_total"].iloc[0]), terms)
        out = []
        for a in range(len(sources)):
            rows = np.flatnonzero(held[:, a])
            mine, other, common = p[rows, a][:, None], p[rows], held[rows]
            value = distance(mine, other) - distance(none[a], other) - distance(mine, none) + distance(none[a], none)
            value = np.where(common, value, 0).sum(axis=0)
            out.append(pd.DataFrame({"source": sources[a], "item": sources, "ordinal": -1, "value": value})[np.arange(len(sources)) != a])
            more = rows[p[rows, a] > q[rows]]
            v = distance(p[more, a], q[more])
            first = np.lexsort((ordinals[more], -v))[:TOP]
            out.append(pd.DataFrame({"source": sources[a], "item": None, "ordinal": ordinals[more][first], "value": v[first]}))
        out = pd.concat(out).assign(lang=key[0])
        return out.astype({c: object for c in ("lang", "source", "item")})[["lang", "source", "item", "ordinal", "value"]]

    return (rows.groupBy("lang", F.floor(F.col("ordinal") / F.col("span")).alias("block"))
                .applyInPandas(block, "lang string, source string, item string, ordinal long, value long"))


def absent(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms that one of two sources lacks add to their distance, from the
    histogram of each source's counts. One row per direction and ordered pair, as many as the result has."""
    hist = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("h")).withColumnRenamed("source", "me")
    other = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
    pairs = groups.withColumnRenamed("source", "me").join(other, "lang").where("me <> other")

    def parts(key, hist, pairs):
        lang, me = key
        if not len(pairs) or not pairs["terms"].iloc[0]:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("lang", "source", "item", "value")})
        terms, total = int(pairs["terms"].iloc[0]), int(pairs["total"].iloc[0])
        n, h = hist["n"].to_numpy(np.int64), hist["h"].to_numpy(np.int64)
        p, none, rest = share(n, total, terms), share(0, total, terms), terms - int(h.sum())
        theirs = share(0, pairs["other_total"].to_numpy(np.int64), terms)
        here, there = [], []
        for q in theirs:  # one value per other source
            here.append(int((h * (distance(p, q) - distance(none, q))).sum()))
            there.append(int((h * distance(q, p)).sum()) + rest * int(distance(q, none)))
        n_others = len(pairs)
        return pd.DataFrame({"lang": lang, "source": [me] * n_others + list(pairs["other"]), "item": list(pairs["other"]) + [me] * n_others, "value": here + there})

    return (hist.groupBy("lang", "me").cogroup(pairs.groupBy("lang", "me"))
                .applyInPandas(parts, "lang string, source string, item string, value long"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by distance (``pair``) and
    the group's terms that stand out most against the language (``term``), at most ``top``."""
    if top > TOP:
        raise ValueError(f"at most {TOP} terms a group")
    rows = prepared(docs)
    vocab = stage(vocabulary(rows, least))
    machines = stage(transducers(vocab, block))
    counts = stage(recount(rows, machines, most_bytes))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = vocab.groupBy("lang").agg(F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = stage(rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
                       .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")))
    found = stage(compare(counts, groups))

    others = groups.select("lang", F.col("source").alias("item"))
    every = groups.select("lang", "source").join(others, "lang").where("source <> item").withColumn("value", zero)
    pair = (every.unionByName(found.where("ordinal < 0").drop("ordinal")).unionByName(absent(counts, groups))
                 .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    term = found.where("ordinal >= 0").drop("item").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    term = term.join(vocab, ["lang", "ordinal"]).withColumnRenamed("term", "item").withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(columns).unionByName(term.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS txt FROM documents
), t AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(txt, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3
), nv AS (
  SELECT lang, count(*)::HUGEINT AS n_terms FROM v GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN v ON t.lang = v.lang AND t.term = v.term GROUP BY t.lang, t.source, t.term
), g AS (
  SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + nv.n_terms) AS p
  FROM g JOIN v ON v.lang = g.lang JOIN nv ON nv.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), q AS (
  SELECT v.lang, v.term, 1 + (1000000000 * (coalesce(s.n, 0) + 1)) // (l.total + nv.n_terms) AS q
  FROM v JOIN nv ON nv.lang = v.lang JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM g GROUP BY lang) l ON l.lang = v.lang
  LEFT JOIN (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) s ON s.lang = v.lang AND s.term = v.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS place FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS place FROM terms
)
SELECT lang, source, part, item, value, place::INTEGER AS "rank" FROM ranked WHERE part = 'pair' OR place <= 200
"""
