import gc

import pytest
from pyspark.sql import functions as F

from pairmeter.functions import exprs, labels as L
from pairmeter.operators import extract as X, tables as T
from pairmeter.sources import readers


def one(spark, value, fn, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("cell,value", [("  **61.07** ", 61.07), ("98.2%", 98.2), ("40.1 (39.9 / 40.4)", 40.1), ("0", 0.0),
                                        ("n/a", None), ("   ", None), ("HellaSwag (10-shot)", None), ("-0.5", -0.5)])
def test_number(spark, cell, value):
    assert one(spark, cell, T.number) == value


@pytest.mark.parametrize("cells,label,nums", [
    (["group", "ARC (25-shot)", "60.4", "59.9%"], "ARC (25-shot)", [60.4, 59.9]),
    (["ARC", "7", "note", "60.4"], "note", [60.4]), (["only text", ""], "only text", []), (["1.5", "2.5"], None, [1.5, 2.5])])
def test_parse_row(spark, cells, label, nums):
    r = one(spark, cells, T.parse_row, "array<string>")
    assert (r["label"], r["nums"]) == (label, nums)


@pytest.mark.parametrize("label,task", [
    ("MMLU-Pro", "mmlu_pro"), ("**HumanEval+**", "humaneval_plus"), ("Average score", None), ("   ", None), ("throughput", None)])
def test_task_label(spark, label, task):
    assert one(spark, label, L.canonical_task) == task


PIPE = "| t | a | b |"


@pytest.mark.parametrize("n", [1_000, 20_000, 100_000])
def test_long_pipe_tables(spark, n):
    body = "\n".join(["intro | x", "|h|a|b|", "|---|:--:|--|", *[f"| r{i} | {i} | 1 |" for i in range(n)], "outro", PIPE, PIPE.upper(), "", PIPE])
    got = spark.createDataFrame([(body,)], "v string").select(F.explode(T.pipe_tables(F.col("v"))).alias("rows")).select(
        F.size("rows").alias("n"), F.col("rows")[0].alias("first"), F.element_at("rows", -1).alias("last")).collect()
    assert [r.n for r in got] == [n + 1, 2]
    assert got[0].first == ["h", "a", "b"] and got[0].last == [f"r{n - 1}", str(n - 1), "1"] and got[1].last == ["T", "A", "B"]


@pytest.mark.parametrize("html,tables", [
    ("<table><tr><th> a  b</th><td>1&amp;2&lt;</td></tr><tr></tr></table>", [[["a b", "1&2<"]]]),
    ("<table><tr><td>x<td>y</td></tr></table>", [[["y"]]]),
    ("<tr><td>no table</td></tr><table></table><table><tr><td>open", []),
    ("<table><tr><td>outer<table><tr><td>in<b>n</b>er</td></tr></table></td></tr></table>", [[["inner"]]]),
    ("<TABLE><TR><TD>1</TD></TR></TABLE></table><table><tr><td>2</td></tr></table>", [[["1"]], [["2"]]]), ("<![", [])])
def test_html_tables(html, tables):
    assert T.read_html(html) == tables


def test_html_pages_are_freed_at_once():
    gc.collect()
    gc.disable()
    try:
        T.read_html("<table>" + "<tr><td>1</td></tr>" * 50 + "</table>")
        assert not [x for x in gc.get_objects() if isinstance(x, T._Stream)]
    finally:
        gc.enable()


@pytest.mark.parametrize("name,scheme,size,family,cluster", [
    ("Pub/Mixtral-8x7B-Instruct-quantized.w4a16", "w4a16", 56.0, "mistral", "Mixtral-8x7B-Instruct"),
    ("Pub/Llama-3.2-3B-Instruct-FP8-dynamic", "fp8_dynamic", 3.0, "llama-3", "Llama-3.2-3B-Instruct"),
    ("Pub/diffusiongemma-26B-A4B-NVFP4", "nvfp4", 26.0, "other", "diffusiongemma-26B-A4B"),
    ("Pub/phi-4", None, None, "other", "phi-4")])
def test_identity(spark, name, scheme, size, family, cluster):
    r = spark.createDataFrame([(name, "", 999)], "doc_id string, text string, n_bytes long").transform(X.describe).first()
    assert (r.scheme, r.params_b, r.family, r.base_model) == (scheme, size, family, cluster)


@pytest.mark.parametrize("p,band", [(0.5, "<2B"), (1.9, "<2B"), (2.0, "2-10B"), (10.0, "2-10B"), (10.1, ">10B"), (None, "unknown")])
def test_size_band(spark, p, band):
    assert one(spark, p, exprs.size_band, "double") == band


@pytest.mark.parametrize("name,moe", [("Mixtral-8x7B", True), ("Qwen3-30B-A3B", True), ("Llama-4-Scout-17B-16E-Instruct", True), ("gemma-2-9b-it", False)])
def test_moe(spark, name, moe):
    assert one(spark, name, exprs.is_moe) is moe


HEAD = "# x\n" + "filler " * 40 + "\n## Evaluation\n"
ID = "Pub/Qwen2.5-7B-Instruct-quantized.w4a16"


def run(spark, *bodies):
    docs = spark.createDataFrame([(f"Pub{i}/" + ID.split("/")[1], HEAD + b) for i, b in enumerate(bodies)], "doc_id string, text string")
    rows, rej = X.extract(docs.withColumn("n_bytes", F.octet_length("text").cast("long")))
    key = lambda r: (r.model, r.benchmark)
    return sorted(rows.collect(), key=key), sorted(rej.collect(), key=key)


def md(head, *rows):
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head)] + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def test_orientation_by_recovery_in_either_order(spark):
    h = ["Task", "A", "B", "C"]
    rows, _ = run(spark, md(h, ["MMLU", "64.20", "61.95", "96.5%"]), md(h, ["MMLU", "61.95", "64.20", "96.5%"]),
                  md(["Task", "Recovery", "x", "y"], ["GPQA", "97.25", "40.00", "38.90"]))
    assert [(r.acc_before, r.acc_after, r.orient_src) for r in rows] == [
        (64.2, 61.95, "arith"), (64.2, 61.95, "arith"), (40.0, 38.9, "arith")]


def test_ambiguous_sign_comes_from_the_header(spark):
    rows, _ = run(spark, md(["Task", "A", "B", "Recovery"], ["MMLU", "50.0", "50.0", "100.0"]),
                  md(["Task", "A", "B", "Recovery"], ["MMLU", "50.0", "50.02", "100.02"]))
    assert [(r.acc_before, r.acc_after, r.orient_src) for r in rows] == [(50.0, 50.0, "arith"), (50.0, 50.02, "header")]


def test_a_wrong_recovery_does_not_swap_the_columns_a_header_names(spark):
    h = ["Task", "Base", "Quant (this model)", "Recovery"]
    rows, rej = run(spark, md(h, ["MMLU", "91.0", "78.37", "116.12"]), md(["Task", "A", "B", "Recovery"], ["MMLU", "91.0", "78.37", "116.12"]),
                    md(h, ["MMLU", "91.0", "78.37", "86.12"]))
    assert [(r.acc_before, r.acc_after, r.orient_src) for r in rows] == [(78.37, 91.0, "arith"), (91.0, 78.37, "arith")]
    assert [r.reason for r in rej] == ["recovery_mismatch"]


def test_rejects_carry_a_reason(spark):
    rows, rej = run(spark, md(["Task", "A", "B", "C"], ["MMLU", "81.40", "80.20", "60%"], ["Average", "1", "2", "3"], ["Foo", "1", "2", "3"], ["GSM8K", "9.0"]),
                    md(["T", "Base", "Quantized"], ["MMLU", "80.69", "80.55"], ["MMLU", "1", "2"]))
    assert [(r.acc_before, r.acc_after, r.orient_src) for r in rows] == [(80.69, 80.55, "header_only")]
    assert sorted(r.reason for r in rej) == sorted(["recovery_mismatch", "aggregate_row_ignored", "benchmark_not_whitelisted",
                                                    "numeric_run_len_1", "duplicate_benchmark_discarded"])


def test_broken_html_keeps_what_was_read(spark):
    assert T.read_html("<table><tr><td>a</td><td>b </td></tr></table><table><tr><td>c") == [[["a", "b"]]]
    rows, _ = run(spark, "<table><tr><th>T</th><th>Base</th><th>FP8</th></tr><tr><td>MMLU</td><td>80</td><td>79</td></tr></table>")
    assert rows[0].delta == -1.0 and rows[0].verified == 0


def test_reconciliation_parks_the_high_baseline(spark):
    t = lambda v: md(["T", "Base", "FP8"], ["GPQA (0-shot)", v, v])
    rows, _ = run(spark, t("31.63"), t("46.10"), t("46.10"))
    assert sorted(r.benchmark for r in rows) == ["gpqa_ambiguous_46", "gpqa_ambiguous_46", "gpqa_main"]


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "Pub_a_b.md").write_text("héllo")
    r = readers.read_documents(spark, str(tmp_path)).first()
    assert (r.doc_id, r.text, r.n_bytes) == ("Pub/a_b", "héllo", 6)


def test_missing_evidence_raises(spark, tmp_path):
    with pytest.raises(readers.MissingEvidence):
        readers.read_evidence(spark, str(tmp_path / "nothing"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(readers.MissingEvidence):
        readers.read_evidence(spark, str(tmp_path / "empty"))
