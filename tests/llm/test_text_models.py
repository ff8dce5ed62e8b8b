import hashlib

import duckdb
import numpy as np
import pytest
from llm_data import prose

from pairmeter.llm import fingerprint, langid, quality
from pairmeter.llm.common import shingle_sets, word_hashes

SF = "/root/testdata/sf0.01"


def test_word_hashes_cut_anywhere():
    text = ("Ab aB  ab\tcd\n" + "x" * 300 + " é É\x0b" + "y " * 50).encode()
    buf = np.frombuffer(text, np.uint8)
    whole = word_hashes(buf)
    for segment in (1, 3, 7, 64):
        part = word_hashes(buf, segment)
        assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])
    assert len(whole[0]) == len(text.split()) and whole[0][0] == whole[0][1] == whole[0][2]


def test_shingle_sets_are_sets_of_words():
    texts = ["a b c a b c a b", "A B C", "a b", "b a", "a", "", None, "a b c a b d", "  a\nb  "]
    got = [set(s.tolist()) for s in shingle_sets(texts, 3)]
    assert [len(s) for s in got] == [3, 1, 1, 1, 1, 0, 0, 4, 1]
    assert got[1] < got[0] and got[2] != got[3] and got[2] == got[8] and len(got[0] & got[7]) == 3


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet' where lang is not null").fetchall())
    held = [d for d in truth if got[d].held_out]
    assert len(held) > 200 and np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() > 0.99 * docs.count()


def test_languages_of_odd_rows(odd_documents, no_documents, spark):
    got = langid.predict(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 8, 10)} == {"und"}
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.predict(no_documents).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(unlabelled).first().lang_pred == "und"
    # a script never seen is rejected
    strange = odd_documents.selectExpr("doc_id + 100 as doc_id", "repeat('日本語の文章です。', 30) as text", "cast(null as string) as lang")
    mixed = odd_documents.select("doc_id", "text", "lang").unionByName(strange)
    assert all(r.rejected for r in langid.predict(mixed).where("doc_id > 100").collect())


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    truth = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet' where quality is not null").fetchall())
    held = [d for d in truth if d in got and got[d].held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.9
    good, bad = ([got[d].score for d in held if truth[d] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (6, 0, 1), (9, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.scores(odd_documents, labels).count() == odd_documents.count()
    assert all(r.score == 0.5 for r in quality.scores(odd_documents, labels.where("false")).collect())
    assert quality.scores(no_documents, labels).count() == 0


def test_isotonic_pools_violators():
    x, y = quality.isotonic([1, 2, 3, 4], [0.0, 1.0, 0.0, 1.0], [1, 1, 1, 1])
    assert np.allclose(y, [0, 0.5, 1]) and np.allclose(x, [1, 2.5, 4])


def test_statistics_do_not_depend_on_neighbours():
    texts = [prose(1, 300), "", None, "A | B | C\nA | B | C", "x" * 1000, "no no no no", prose(2, 5) + "\n" + prose(2, 5)]
    together = quality.statistics(texts)
    assert np.allclose(together, np.vstack([quality.statistics([t]) for t in texts])) and np.isfinite(together).all()


def _walk(text):
    """The embedding of one block, a character at a time."""
    level = int(fingerprint._levels(np.array([len(text)]))[0])
    out, i = [], 0
    for j in range(3 * len(text)):
        if i >= len(text):
            break
        c = ord(text[i])
        symbol = (c ^ (c >> 8) * 31) & 255
        if j % 2**level == 0:
            out.append("%x" % fingerprint._DIGITS[j % fingerprint.PERIOD, symbol])
        i += int(fingerprint._MOVES[j % fingerprint.PERIOD, symbol])
    return chr(97 + level) + "".join(out)


def test_fingerprints_against_a_plain_walk():
    texts = [prose(1, 30), "a", "", prose(2, 2000), "é日𝒳" * 40, prose(3, 400), prose(1, 30)]
    got = fingerprint.fingerprints(texts)
    want = [".".join(_walk(t[i:i + fingerprint.BLOCK]) for i in range(0, len(t), fingerprint.BLOCK)) for t in texts]
    assert got == want


def test_likeness_falls_with_edits():
    scores = []
    for seed in range(20):
        text = prose(seed, 600)
        few, many = text.split(" "), text.split(" ")
        few[30 * seed] = "unusual"
        many[::3] = ["changed"] * len(many[::3])
        f = fingerprint.fingerprints([text, " ".join(few), " ".join(many), prose(100 + seed, 600)])
        scores.append([fingerprint.likeness(f[0], x) for x in f])
    same, few, many, none = np.mean(scores, axis=0)
    assert same == 1 and few > 0.7 and few - 0.3 > max(many, none)
    assert fingerprint.likeness("", "") == 1 and fingerprint.likeness("", f[0]) == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_edited_texts_follow_descending_ids(spark, odd_documents, no_documents, partitions):
    rows = odd_documents.collect()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint.describe(odd_documents).collect()
        assert fingerprint.describe(no_documents).count() == 0
        lone = fingerprint.describe(odd_documents.where("doc_id = 9")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), (r.text or "").encode()) for r in rows))
    texts = [t.decode() for *_, t in order]
    want = []
    for k, (null, neg, _) in enumerate(order):
        t, s = texts[k], texts[(k + 1) % len(texts)]
        edited = t[:len(t) - len(t) // 2] + s[:len(t) // 2]
        want.append((-1 if null else -neg, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert lone.near_next == 1 and lone.n_chars == len(next(r.text for r in rows if r.doc_id == 9))
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1 and by[4].fingerprint == ""


def test_bands_find_near_copies(spark, odd_documents):
    base = prose(50, 500).split(" ")
    rows = [(i, " ".join(base[:i * 10] + ["new"] + base[i * 10:])) for i in range(1, 5)] + [(100 + i, prose(60 + i, 500)) for i in range(20)] + [(200, rows_text := prose(60, 500))]
    got = {r.doc_id: r.component_id for r in fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert rows_text and got[200] == 100 and all(got[100 + i] == 100 + i for i in range(20))
    assert len({got[i] for i in range(1, 5)}) < 4
    assert fingerprint.near_duplicates(odd_documents).count() == odd_documents.count()
