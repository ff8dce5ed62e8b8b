"""Phrases whose words keep company, counted in depth-truncated suffix trees by vertical partitioning.

Texts are cut into pieces and words; a suffix starts at every word of a piece and is followed for at most
five words. The suffixes of a language are partitioned by prefix: a word is a prefix of its own unless more
suffixes start with it than one task may hold; such a prefix is opened, its continuations are counted, and
those above the budget are opened in turn, word by word. Prefixes are packed into groups below the budget.
Map tasks sort the suffixes of a stretch of text, fold equal ones and send one compressed run per group;
the task of a group merges its runs into the sorted suffixes, that is the truncated tree, and reads the
count of every node off the totals of the leaves below it. No group depends on another.

A phrase can only be frequent if each of its words is, so words below the threshold end a suffix. The most
frequent words (``WORDS``, a bound on what is sent to the tasks, and all above the budget) travel as small numbers, which makes runs
short; any other frequent word travels as 62 bits of its hash. Should two words share those bits, the
frequent ones of them are numbered, so counts stay exact.

All scores are exact: products are decimals of 38 digits, divided as integers.

Defined cases: a null text is empty; a null language is ``und``; texts without words count nothing; every
row counts, so repeated rows count as often as they occur; a text of any length is read whole, in segments
cut at the end of a piece; equal scores are ordered by count, then by the UTF-8 bytes of the phrase; an
empty table gives no rows; extra columns are ignored.
"""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairmeter.llm.common import read, stage

LEAST, DEPTH, FIRST = 100, 5, 2000
#: Suffixes a group may hold, words that travel as numbers and their longest one in bytes, words a task
#: counts before it hands its counts on, and words whose suffixes are sorted at once.
BUDGET, WORDS, LONGEST, HELD, STRETCH = 1 << 19, 1 << 18, 64, 1_000_000, 1 << 20

#: A to Z in lower case, a tab as a space, and whatever ends a piece as a full stop.
_WORD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_END = b"."
#: Numbers of words are below this bit, hashes have it set.
_HASHED = 1 << 62


def segments(text, size: int = 1 << 20):
    """The words of a text as UTF-8 bytes, with a full stop where a piece ends, in lists cut at such ends."""
    data = (text or "").encode("utf-8", "replace").translate(_WORD)
    at = 0
    while at < len(data):
        stop = data.find(_END, at + size) + 1 or len(data)
        yield data[at:stop].replace(_END, b" . ").split()
        at = stop


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""
    def count(frames):
        held, size = {}, 0
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                seen = held.setdefault(lang, Counter())
                before = len(seen)
                for words in segments(text):
                    seen.update(words)
                size += len(seen) - before
                if size > HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    def flush(held):
        for lang, seen in held.items():
            seen.pop(_END, None)
            if seen:
                yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8") for w in seen], "n": np.fromiter(seen.values(), np.int64, len(seen))})

    return rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def alphabet(counts: DataFrame, least: int, most_words: int, budget: int) -> DataFrame:
    """(lang, word, n, symbol) of the words that occur at least ``least`` times: a number from 1 in every
    language, by falling frequency, or the word's hash."""
    bits = F.shiftrightunsigned(F.xxhash64("word"), 2).bitwiseOR(F.lit(_HASHED))
    counts = counts.withColumn("bits", bits)
    shared = (counts.groupBy("lang", "bits").agg(F.count("*").alias("words"), F.max("n").alias("top"))
                    .where((F.col("words") > 1) & (F.col("top") >= least)).select("lang", "bits", F.lit(True).alias("clash")))
    frequent = stage(counts.where(F.col("n") >= least).join(shared, ["lang", "bits"], "left"))
    low = 0
    if frequent.count() > most_words:
        low = frequent.select("n").orderBy(F.desc("n")).limit(max(1, most_words)).agg(F.min("n")).first()[0] + 1
    short = (F.col("n") >= low) & (F.octet_length("word") <= LONGEST)
    numbered = frequent.where(short | F.col("clash") | (F.col("n") > budget)).select("lang", "word")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")).cast("long")
    numbers = frequent.join(numbered, ["lang", "word"], "left_semi").select("lang", "word", "n", place.alias("symbol"))
    rest = frequent.join(numbered, ["lang", "word"], "left_anti").select("lang", "word", "n", F.col("bits").alias("symbol"))
    return numbers.unionByName(rest)


class Language:
    """The words of a language, and the group of every suffix made of them."""

    def __init__(self, words, hashed_total: int, budget: int):
        """``words``: frame of word and n, in the order of their numbers."""
        self.budget, self.hashed = budget, hashed_total > 0
        self.symbol = {w.encode("utf-8"): i for i, w in enumerate(words["word"], 1)}
        n = np.concatenate([[0], words["n"].to_numpy(np.int64)])
        self.group = np.cumsum(np.where(n > budget, 0, n)) // budget
        self.groups, self.hash_groups = int(self.group.max()) + 1, 1 + 2 * hashed_total // budget
        self.levels = []
        self.open(np.zeros(0, np.int64), np.flatnonzero(n > budget), n[n > budget])

    def open(self, states, symbols, n):
        """Opens the prefixes that continue the open prefixes ``states`` with ``symbols``; none below the root."""
        if not len(symbols):
            return
        states = states if self.levels else np.zeros(len(symbols), np.int64)
        known = np.unique(symbols)
        key = states * len(known) + np.searchsorted(known, symbols)
        order = np.argsort(key)
        width = 1 + 2 * n[order] // self.budget
        first = self.groups + np.cumsum(width) - width
        self.groups += int(width.sum())
        self.levels.append((known, key[order], first, width))

    def symbols(self, words) -> np.ndarray:
        get = self.symbol.get
        if not self.hashed:
            return np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        return np.fromiter([get(w) or (0 if w == _END else xxhash.xxh64_intdigest(w, seed=42) >> 2 | _HASHED) for w in words], np.int64, len(words))

    def walk(self, columns):
        """Per level: the suffixes whose prefix is open there, and the prefix's place among the open ones."""
        live, state = np.arange(len(columns[0])), np.zeros(len(columns[0]), np.int64)
        for depth, (known, keys, _, _) in enumerate(self.levels):
            c = columns[depth][live]
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            hit = known[at] == c
            live, key = live[hit], state[hit] * len(known) + at[hit]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            live, state = live[hit], at[hit]
            yield depth, live, state

    def groups_of(self, columns):
        """(group, number of words of its open prefix) of every suffix."""
        first = columns[0]
        small = first < len(self.group)
        group = np.where(small, self.group[np.where(small, first, 0)], -1 - first % self.hash_groups)
        opened = np.zeros(len(first), np.int64)
        for depth, live, state in self.walk(columns):
            _, _, base, width = self.levels[depth]
            spread = (columns[depth + 1][live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            group[live] = base[state] + spread.astype(np.int64) % width[state]
            opened[live] = depth + 1
        return group, opened


def suffixes(symbols, depth: int = DEPTH):
    """The columns of the suffixes of at least two words; 0 past the end."""
    padded = np.concatenate([symbols, np.zeros(depth, np.int64)])
    columns = [symbols]
    for j in range(1, depth):
        columns.append(np.where(columns[-1] > 0, padded[j:j + len(symbols)], 0))
    some = columns[1] > 0
    return [c[some] for c in columns]


def in_order(columns):
    """The order that sorts rows by all columns, and those columns in it."""
    high = max((int(c.max()) for c in columns if len(c)), default=0)
    if high < 1 << 21:  # two sort keys in place of five
        pad = columns + [np.zeros_like(columns[0])] * (-len(columns) % 3)
        keys = [pad[i] << 42 | pad[i + 1] << 21 | pad[i + 2] for i in range(0, len(pad), 3)]
    else:
        keys = columns
    order = np.lexsort(keys[::-1])
    return order, [c[order] for c in columns]


def changes(columns):
    """Per depth: whether a sorted row's prefix of that length differs from the row's before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        yield new


def packed(columns) -> bytes:
    wide = "<i8" if max(int(c.max()) for c in columns) >> 31 else "<i4"
    planes = np.stack(columns).astype(wide).view(np.uint8).reshape(-1, int(wide[2])).T
    return wide.encode() + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(run: bytes, n_columns: int) -> np.ndarray:
    wide = run[:3].decode()
    planes = np.frombuffer(zlib.decompress(run[3:]), np.uint8).reshape(int(wide[2]), -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(wide).astype(np.int64).reshape(n_columns, -1)


def stretches(frames, languages):
    """(language, symbols) of stretches of whole segments, a 0 after each."""
    held, size = {}, 0
    for f in frames:
        for lang, text in zip(f["lang"], f["text"]):
            own = languages.get(lang)
            for words in segments(text) if own else ():
                held.setdefault(lang, []).extend([own.symbols(words), np.zeros(1, np.int64)])
                size += len(words)
                if size > STRETCH:
                    yield from ((k, np.concatenate(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, np.concatenate(v)) for k, v in held.items())


def continuations(rows: DataFrame, sent, depth: int) -> DataFrame:
    """(lang, state, symbol, n): how often the open prefixes of ``depth`` words go on with a word. Only a
    word above the budget can make a prefix above it, so only the open words count."""
    def count(frames):
        languages = {lang: own for lang, own in sent.value.items() if len(own.levels) == depth}
        for lang, symbols in stretches(frames, languages):
            columns = suffixes(symbols)
            *_, (_, live, state) = languages[lang].walk(columns)
            symbol = columns[depth][live]
            some = np.isin(symbol, languages[lang].levels[0][0])
            order, (state, symbol) = in_order([state[some], symbol[some]])
            *_, new = changes([state, symbol])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            if len(at):
                yield pd.DataFrame({"lang": lang, "state": state[at], "symbol": symbol[at], "n": n})

    return (rows.mapInPandas(count, "lang string, state long, symbol long, n long")
                .groupBy("lang", "state", "symbol").agg(F.sum("n").alias("n")))


def runs(rows: DataFrame, sent) -> DataFrame:
    """(lang, part, opened, run): the sorted, folded suffixes of a stretch that belong to a group."""
    def cut(frames):
        languages = sent.value
        for lang, symbols in stretches(frames, languages):
            columns = suffixes(symbols)
            if not len(columns[0]):
                continue
            _, columns = in_order(columns)
            *_, new = changes(columns)
            at = np.flatnonzero(new)
            folded = [c[at] for c in columns] + [np.diff(np.append(at, len(new)))]
            group, opened = languages[lang].groups_of(folded[:DEPTH])
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1))
            parts = np.split(order, edges[1:])
            yield pd.DataFrame({"lang": lang, "part": group[order[edges]], "opened": opened[order[edges]], "run": [packed([c[p] for c in folded]) for p in parts]})

    return rows.mapInPandas(cut, "lang string, part long, opened long, run binary")


def nodes(parts: DataFrame, least: int) -> DataFrame:
    """(lang, symbols, n) of every node of at least two words and ``least`` occurrences in all groups."""
    def tree(key, pdf):
        lang, _, opened = key
        table = np.concatenate([unpacked(r, DEPTH + 1) for r in pdf["run"]], axis=1)
        order, columns = in_order(list(table[:DEPTH]))
        leaves = table[DEPTH][order]
        symbols, counts = [], []
        for depth, new in enumerate(changes(columns), 1):
            at = np.flatnonzero(new)
            total = np.add.reduceat(leaves, at)
            # the nodes on the way to an open prefix have leaves in several groups
            wanted = (columns[depth - 1][at] > 0) & ((total >= least) | (depth <= opened))
            if depth > 1:
                symbols += list(np.stack([c[at[wanted]] for c in columns[:depth]], axis=1))
                counts += total[wanted].tolist()
        return pd.DataFrame({"lang": pd.Series([lang] * len(symbols), dtype=object), "symbols": pd.Series(symbols, dtype=object), "n": counts})

    found = parts.groupBy("lang", "part", "opened").applyInPandas(tree, "lang string, symbols array<long>, n long")
    return found.groupBy("lang", "symbols").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, most_words: int = WORDS) -> DataFrame:
    """(lang, words, phrase, a, n): every phrase of one to five words with at least ``least`` occurrences,
    its count and the number of all words of its language."""
    rows, spark = prepared(docs), docs.sparkSession
    counts = stage(word_counts(rows))
    letters = stage(alphabet(counts, least, most_words, budget))
    numbered = letters.where(F.col("symbol") < _HASHED).orderBy("lang", "symbol").toPandas()
    hashed = dict(letters.where(F.col("symbol") >= _HASHED).groupBy("lang").agg(F.sum("n")).collect())
    languages = {lang: Language(numbered[numbered["lang"] == lang], hashed.get(lang, 0), budget) for lang in {*numbered["lang"], *hashed}}
    sent = spark.sparkContext.broadcast(languages)
    for depth in range(1, DEPTH - 1):
        open_ = [lang for lang, own in languages.items() if len(own.levels) == depth]
        if not open_:
            break
        # at most as many as the corpus has words, divided by the budget
        more = continuations(rows.where(F.col("lang").isin(open_)), sent, depth).where(F.col("n") > budget).toPandas()
        for lang in open_:
            m = more[more["lang"] == lang]
            languages[lang].open(m["state"].to_numpy(np.int64), m["symbol"].to_numpy(np.int64), m["n"].to_numpy(np.int64))
        sent = spark.sparkContext.broadcast(languages)
    found = stage(nodes(runs(rows, sent), least))
    spelt = (found.select("lang", "symbols", "n", F.posexplode("symbols").alias("place", "symbol"))
                  .join(letters.select("lang", "symbol", "word"), ["lang", "symbol"])
                  .groupBy("lang", "symbols").agg(F.first("n").alias("a"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
                  .select("lang", F.transform("w", lambda x: x["word"]).alias("words"), "a"))
    single = letters.select("lang", F.array("word").alias("words"), F.col("n").alias("a"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return spelt.unionByName(single).join(total, "lang").select("lang", "words", F.array_join("words", " ").alias("phrase"), "a", "n")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, budget: int = BUDGET, most_words: int = WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of every language by the score of
    their weakest cut, without those that a longer phrase of equal count contains."""
    all_ = stage(phrases(docs, least, budget, most_words))
    length = F.size("words")
    long = all_.where(length > 1)

    # a longer phrase that contains another, with equal count, holds one longer by a single word that does too
    inner = F.array(F.slice("words", 1, length - 1), F.slice("words", 2, length - 1))
    longer = (all_.where(length > 2).select("lang", "a", F.explode(inner).alias("p")).groupBy("lang", F.array_join("p", " ").alias("phrase"))
                  .agg(F.max("a").alias("within")))
    long = long.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a"))).drop("within")

    k = F.col("k")
    cuts = (long.select("*", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
                .withColumn("left", F.array_join(F.slice("words", F.lit(1), k), " "))
                .withColumn("right", F.array_join(F.slice("words", k + 1, length - k), " ")).drop("words"))
    cuts = cuts.join(all_.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(all_.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    wide = {c: f"cast({c} as decimal(18,0))" for c in "anlr"}
    score = F.expr(f"cast(({wide['a']} * {wide['n']} * cast(1000 as decimal(4,0))) div ({wide['l']} * {wide['r']}) as long)")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase")
                .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4), (5)) x(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT f.lang, f.k, f.phrase, f.a, n.n, string_split(f.phrase, ' ') AS ws FROM f JOIN n ON n.lang = f.lang WHERE f.k > 1 AND f.a >= 100
), o AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
), t AS (
  SELECT *, unnest(range(1, k)) AS cut FROM o
), s AS (
  SELECT t.lang, t.phrase, t.a, t.n, t.cut, l.a AS l, r.a AS r, (1000 * t.a * t.n) // (l.a * r.a) AS score
  FROM t JOIN f l ON l.lang = t.lang AND l.phrase = array_to_string(t.ws[1:t.cut], ' ') AND l.k = t.cut
         JOIN f r ON r.lang = t.lang AND r.phrase = array_to_string(t.ws[t.cut + 1:t.k], ' ') AND r.k = t.k - t.cut
), m AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s
), q AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM m WHERE nth = 1
)
SELECT lang, place::BIGINT AS "rank", phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM q WHERE place <= 2000
"""
