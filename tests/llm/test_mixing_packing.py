import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pairmeter.llm import mixing, packing


def test_mix_keeps_columns_and_meets_targets(odd_documents):
    t = {(r.doc_id, r.size, r.taken): r for r in mixing.taken(odd_documents).collect()}
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in t.values())
    mixed = mixing.mix(odd_documents)
    assert mixed.columns == odd_documents.columns
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert words(mixed.collect()) == sum(r.taken for r in mixing.taken(odd_documents).collect())


def test_repeated_runs_agree_and_budgets_nest(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', id % 5) as source")
    a = sorted(map(tuple, mixing.taken(docs).collect()))
    assert a == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()))
    half = {r.doc_id: r.taken for r in mixing.taken(docs, share=0.5).collect()}
    assert all(half[r[0]] <= r[4] for r in a)
    by = Counter()
    for r in a:
        by[r[3]] += r[4]
    assert all(abs(v - target * n) <= 8 * n for target, v in by.items() for n in [sum(1 for x in {y[2:4] for y in a} if x[1] == target)])


def test_no_documents(no_documents):
    assert mixing.taken(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0
    assert packing.pack(no_documents, packing.default_path()).count() == 0


def test_mixing_sql_with_odd_rows(spark, odd_documents, tmp_path):
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").distinct()
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = Counter(con.execute(mixing.SQL).fetchall())
    got = Counter(tuple(r) for r in mixing.taken(docs).collect())
    assert {k[:3] + (round(k[3], 6), k[4]): v for k, v in got.items()} == {k[:3] + (round(k[3], 6), k[4]): v for k, v in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing_is_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    number, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for length, k, at in zip(lengths, number, offset):  # a plain scan for the tightest window
        fits = [r for r in rooms if r >= length]
        if fits:
            assert 64 - at == min(fits) == rooms[k]
            rooms[k] -= length
        else:
            assert k == len(rooms) and at == 0
            rooms.append(64 - length)


def test_packing_returns_every_token_once(odd_documents):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_path())
    t.encode_special_tokens = True
    got = packing.pack(odd_documents, packing.default_path(), with_ids=True)
    rows = got.collect()
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in odd_documents.collect())
    whole = Counter()
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.start == 0 and r.length == r.doc_tokens:
            whole[r.doc_id, tuple(r.ids)] += 1
    long = sorted((r.start, r) for r in rows if r.doc_id == 9)
    assert [s for s, _ in long] == list(np.cumsum([0] + [r.length for _, r in long])[:-1])
    whole[9, tuple(i for _, r in long for i in r.ids)] += 1
    for r in rows:
        if r.doc_id == 11 and r.doc_tokens > 2048 and r.start == 0:
            whole[11, tuple(i for _, x in sorted((x.start, x) for x in rows if x.doc_id == 11) for i in x.ids)] += 1
    assert whole == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1]) and sum(n for _, n in p) <= 2048
    seqs = packing.sequences(got).collect()
    assert all(len(s.ids) == 2048 or s.tokens & (s.tokens - 1) == 0 for s in seqs)


@pytest.mark.parametrize("text", ["ΣΑΣ <|endoftext|> x y éẞ", "don't\x1cstop\x0b a1b2 ___", " ", "日本語 テスト"])
def test_word_by_word_ids_are_the_tokenizers(text):
    w = packing.WordIds(packing.default_path())
    ids, n = w.encode([text, None, text])
    want = w.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>. <|ENDOFTEXT|> <|endoftext", "x <|endoftext|><|endoftext|>\ty"])
def test_special_tokens_spelt_out_get_the_ids_of_the_default_call(text):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(packing.default_path()).encode(text, add_special_tokens=False).ids
    assert packing.WordIds(packing.default_path()).encode([text])[0].tolist() == want and {49406, 49407} & set(want)


def test_a_word_is_looked_up_once():
    class Counting(dict):
        looks = 0

        def get(self, w):
            Counting.looks += 1
            return dict.get(self, w)

        def __getitem__(self, w):
            Counting.looks += 1
            return dict.__getitem__(self, w)

    words = packing.WordIds(packing.default_path())
    words.held = Counting()
    texts = ["One two, two. three!\n", "one\tfour;x 5. é. a.b c", None, "", "two", " . .", "\x00 two\x0b"]
    for _ in range(2):
        Counting.looks = 0
        got = words.ids_of(texts)
        assert [list(np.frombuffer(x, "<u4")) for x in got] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert Counting.looks == sum(len(packing._MARK.sub(rb" \g<0>", (t or "").lower().encode()).split()) for t in texts)
