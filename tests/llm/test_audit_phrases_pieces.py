import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_data import prose

from pairmeter.llm import collocations, divergence, piece_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def documents_in_duckdb(df, folder):
    df.select(COLUMNS).write.parquet(str(folder))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    return con


# ---- op11 ------------------------------------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="abcé\U0001F600", max_size=6), max_size=60), st.lists(st.text(alphabet="abcdé", max_size=7), max_size=30))
def test_transducer_is_a_minimal_ordinal_map(words, others):
    terms = sorted(w.encode() for w in words)
    t = divergence.Transducer.build(terms)
    assert t.ordinals(terms).tolist() == list(range(len(terms)))
    place = {w: i for i, w in enumerate(terms)}
    asked = [w.encode() for w in others]
    assert t.ordinals(asked).tolist() == [place.get(w, -1) for w in asked]
    # minimal: as many states as there are different sets of endings
    endings = {p: frozenset(w[len(p):] for w in terms if w.startswith(p)) for w in terms for p in [w[:k] for k in range(len(w) + 1)]}
    assert len(t.final) == max(1, len(set(endings.values())))


def test_shares_are_exact_in_64_bits():
    for count, total, terms in [(10**15, 3 * 10**15, 10**9), (0, 0, 1), (5, 7, 3), (10**15 - 1, 10**15 - 1, 1)]:
        assert divergence.share(count, total, terms) == 1 + 10**9 * (count + 1) // (total + terms)


def plain_audit(docs, top=200):
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    docs = [((r.lang or ""), (r.source or ""), term.findall((r.text or "").translate(lower))) for r in docs]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        count = defaultdict(Counter)
        for _, source, words in own:
            count[source].update(w for w in words if seen[w] >= 3)
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in ((s, count[s]) for s in {d[1] for d in own})}
        whole = sum(count.values(), Counter())
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        for s in p:
            pairs = [(o, sum((p[s][w] - p[o][w])**2 // p[o][w] for w in kept)) for o in p if o != s]
            terms = [(w, (p[s][w] - q[w])**2 // q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(ranked if part == "pair" else ranked[:top], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


def test_audit_against_plain_python_and_sql(spark, odd_documents, sf, tmp_path):
    docs = odd_documents.select(COLUMNS).unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(60).select(COLUMNS))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = plain_audit(docs.collect())
    assert rows_of(divergence.audit(docs)) == want
    # blocks of a few terms and rounds of a few bytes give the same rows
    assert rows_of(divergence.audit(docs, block=7, most_bytes=4000)) == want
    assert Counter(documents_in_duckdb(docs, tmp_path / "d").execute(divergence.SQL).fetchall()) == want


def test_audit_in_blocks_of_few_cells(spark, odd_documents, monkeypatch):
    want = plain_audit(odd_documents.collect())
    monkeypatch.setattr(divergence, "CELLS", 12)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert rows_of(divergence.audit(odd_documents)) == want


def test_nothing_to_audit(no_documents, spark):
    assert divergence.audit(no_documents).count() == 0
    rare = spark.createDataFrame([("a", "x", "one two"), ("b", "x", None), (None, None, "")], "source string, lang string, text string")
    assert rows_of(divergence.audit(rare)) == Counter({("x", "a", "pair", "b", 0, 1): 1, ("x", "b", "pair", "a", 0, 1): 1})


def test_long_texts_are_cut_between_words():
    text = "Ünder the-sea " * 500
    assert sum(divergence.words(text, 64), []) == sum(divergence.words(text), []) == ["Ünder".encode(), b"the", b"sea"] * 500


# ---- op12 ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.default_path())


PIECES = st.sampled_from([*"abet \n\té12.,▁😀执한<s>/\x00ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "the ", "   ", " ̀", "\u0085", "xx"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=40).map("".join), min_size=1, max_size=6))
def test_encoding_equals_the_library(codec, texts):
    ids = [x.tolist() for x in codec.encode(texts)]
    assert ids == codec.library.encode(texts, add_bos=True, add_eos=True)
    assert [codec.decode(x) for x in ids] == codec.library.decode(ids) == [t.replace("▁", " ") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_in_the_library(codec, ids):
    assert codec.decode(ids) == codec.library.decode(ids)


def test_texts_without_cuts_and_a_full_table(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "HELD", 10)
    texts = ["ab" * 20_000, "x" * 30_000, " " * 5_000, prose(3, 500), prose(4, 500), prose(3, 500)]
    assert [x.tolist() for x in codec.encode(texts)] == codec.library.encode(texts, add_bos=True, add_eos=True)


def test_chunks_merged_together_equal_the_agenda(codec):
    pick = random.Random(3)
    names = [p for p in codec.ids if len(p) < 9]
    chunks = ["".join(pick.choice(names) for _ in range(pick.randint(1, 4))) for _ in range(300)]
    chunks += ["".join(pick.choice("aeinrst▁é") for _ in range(pick.randint(1, 40))) for _ in range(300)] + ["a", "aaaaaaa", "\U0001f9ea", "\u0e01"]
    assert codec.ids_together(chunks) == [codec.chunk_ids(c) for c in chunks]
    assert codec.ids_together([]) == []


def test_a_difference_from_the_library_is_an_error(codec, monkeypatch):
    ids = [x.tolist() for x in codec.encode(["the hen"])]
    assert codec.decode_checked(ids) == ["the hen"]
    monkeypatch.setattr(codec, "surface", [s.upper() for s in codec.surface])
    with pytest.raises(ValueError):
        codec.decode_checked(ids)


def test_codec_on_odd_documents(spark, odd_documents, codec):
    path = piece_codec.default_path()
    got = piece_codec.encode(odd_documents, path)
    assert got.columns == odd_documents.columns + ["ids"]
    back = got.select("text", "ids", piece_codec.decode(got["ids"], path).alias("back")).collect()
    want = Counter((r.text, tuple(codec.library.encode(r.text or "", add_bos=True, add_eos=True))) for r in odd_documents.collect())
    assert Counter((r.text, tuple(r.ids)) for r in back) == want
    assert all(r.back == (r.text or "") for r in back)


def test_codec_query(spark, sf, codec):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = piece_codec.query(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = codec.library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()


def test_no_texts_to_encode(no_documents):
    assert piece_codec.encode(no_documents, piece_codec.default_path()).count() == 0


# ---- op13 ------------------------------------------------------------------------------------------

def plain_collocations(docs, least, first=2000):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    count, total = defaultdict(Counter), Counter()
    for r in docs:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (r.text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                count[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = Counter()
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, b: any(b[i:i + len(p)] == p for i in range(len(b) - len(p) + 1))
        rows = []
        for p, a in found.items():
            if any(len(b) > len(p) and n >= a and inside(p, b) for b, n in found.items()):
                continue
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out[lang, rank, phrase.decode(), -a, left, right, total[lang], -score] += 1
    return out


@pytest.fixture(scope="module")
def phrase_documents(spark, odd_documents):
    rows = [(100 + i, (prose(i % 7, 60) + ". A a a a a a a, " + prose(i, 30) + "\tof the the sea; of the\tTHE sea!") * 2, ["en", "fr", None][i % 3], "s", 0) for i in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return odd_documents.select(COLUMNS).unionByName(more)


@pytest.mark.parametrize("options", [{"budget": 40}, {"budget": 3, "most_words": 5}, {"most_words": 0, "first": 7}])
def test_collocations_against_a_plain_count(spark, phrase_documents, options):
    want = plain_collocations(phrase_documents.collect(), 12, options.get("first", 2000))
    got = rows_of(collocations.collocations(phrase_documents, least=12, **options))
    assert len(want) > 15 and got == want


def test_words_that_share_a_hash_are_numbered(spark, phrase_documents, monkeypatch):
    rows = collocations.prepared(phrase_documents)
    counts = collocations.word_counts(rows)
    plain = {(r.lang, r.word): r.symbol for r in collocations.alphabet(counts, 12, 3, 10**6).collect()}
    assert any(s >= 1 << 62 for s in plain.values())
    real = collocations.F.xxhash64
    monkeypatch.setattr(collocations.F, "xxhash64", lambda *c: real(*c) * 0 if c == ("word",) else real(*c))
    clash = {(r.lang, r.word): r.symbol for r in collocations.alphabet(counts, 12, 3, 10**6).collect()}
    assert clash.keys() == plain.keys() and all(s < 1 << 62 for s in clash.values())


def test_collocation_sql(spark, phrase_documents, tmp_path):
    want = plain_collocations(phrase_documents.collect(), 100)
    got = Counter(documents_in_duckdb(phrase_documents, tmp_path / "d").execute(collocations.SQL).fetchall())
    assert got == want == rows_of(collocations.collocations(phrase_documents))


def test_no_phrases(no_documents, spark):
    assert collocations.collocations(no_documents).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", ". , .", ), ("en", None)], "lang string, text string")).count() == 0


def test_segments_end_with_a_piece():
    text = ("one two\tthree. Four\x0bfive ! " * 300) + "six"
    small = list(collocations.segments(text, 50))
    assert len(small) > 50 and sum(small, []) == sum(collocations.segments(text), [])
    assert all(s[-1] == b"." for s in small[:-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 5), min_size=1, max_size=50), st.sampled_from([1, 1 << 40, 1 << 60]))
def test_runs_come_back_as_they_were(rows, scale):
    columns = [np.array(c, np.int64) * scale for c in zip(*rows)]
    order, placed = collocations.in_order(columns)
    assert list(zip(*[c.tolist() for c in placed])) == sorted(zip(*[c.tolist() for c in columns]))
    assert (collocations.unpacked(collocations.packed(placed), 5) == np.stack(placed)).all()
