from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest

from pairmeter.llm import common, jaccard, langid, mixing, registry


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", registry.ORACLES)
def test_every_sql_string_runs(sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert con.execute(registry.ORACLES[name]).fetchone()


def test_stages_one_by_one(spark, sf):
    docs = common.read(spark, sf, "documents")
    seen = [docs]
    for _, step in corpus_pipeline.STAGES:
        seen.append(common.stage(step(spark, seen[-1], sf)))
    assert all(d.columns == docs.columns for d in seen[:-1])
    known = {r.doc_id for r in langid.predict(docs).where("not rejected").collect()}
    assert {r.doc_id for r in seen[1].collect()} == known
    groups = {r.doc_id: r.component_id for r in jaccard.groups(seen[1], 5, 80).collect()}
    assert sorted(r.doc_id for r in seen[2].collect()) == sorted(d for d, c in groups.items() if d == c)
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted(r.doc_id for r in seen[2].collect())
    copies = {r.doc_id: r.taken // r.size for r in mixing.taken(seen[3]).collect() if r.size}
    mixed = Counter(r.doc_id for r in seen[4].collect())
    assert all(mixed[d] == n for d, n in copies.items())
    packed = seen[5].collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == mixed
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_stages_on_odd_rows(spark, which, request):
    docs = request.getfixturevalue(which)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = common.stage(step(spark, docs, ""))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out
    assert (out.count() > 0) == (which == "odd_documents")
