import gzip
import hashlib
import io
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from llm_data import prose

from pairmeter.llm import html_text, pii, warc

CASES = [
    ("<article><h1>A  &amp; b</h1><p>one<b>t</b>wo<br>three<p>four</article><footer>f</footer>", "A & b\n\nonetwo three\n\nfour"),
    ("<body><nav><ul><li>x</ul></nav><main><p>in</p><aside>s</aside><form>q</form><p>out</p></main></body>", "in\n\nout"),
    ("<article>a<script>var t='</p><article>';</script><style>p{}</style><!-- c <p> -->b<div class='user-comments'><p>no</div>c</article>", "a\n\nb\n\nc"),
    ("<article><p>end is missing <foo", "end is missing"),
    ("<article><p>x<!-- open", "x"),
    ("<article><p>x<script>y", "x"),
    ("</div></p>plain &lt;text&gt; &#233; &unknown; 1 < 2", "plain <text> é &unknown; 1 < 2"),
    ("<p hidden>no<p>yes<div style='display: none'>no</div><div class=\"ad\">no</div>", "yes"),
    ("<article><p>A<span class='ad'>no</span>B</article>", "A\n\nB"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text_of_a_page(page, text):
    assert html_text.host_texts([page or ""])[0][0] == text


MARKED = [
    ("<div class='content has-sidebar'><article>a</article></div>", "a"), ("<div class='no-comments share-enabled'><article>a</article></div>", "a"),
    ("<article><div class='entry-header'><h1>T</h1></div>a</article>", "T\n\na"), ("<article>a <a href='/the-hidden-valley'>b</a> c</article>", "a b c"),
    ("<article>a <a href='/p?id=comment-3'>b</a> c</article>", "a b c"), ("<article>a <span data-state='hidden'>b</span></article>", "a b"),
    ("<form><div>m</div><main>a</main></form>", "a"), ("<div class='sidebar'>m<article>a</article></div>", "a"), ("<article>a<div id=comment-3>n</div></article>", "a"),
    ("<div class='related'><article>n</article><article>o</article></div><p>a", "a"), ("<aside><article>n</article></aside><p>a", "a"), ("<p>a<p data-x='b' hidden>n", "a"),
]


@pytest.mark.parametrize("page,text", MARKED)
def test_marks_are_whole_names_and_never_hold_the_article(page, text):
    assert html_text.host_texts([page])[0][0] == text


def test_template_of_a_host_goes_and_unique_runs_stay(spark):
    menu, legal = prose(1, 30), prose(2, 25)
    rows = [(i, f"http://h{i % 2}.example/p{i}", f"<div>{menu}</div><div>{prose(100 + i, 60)}</div><div>{legal} page p{i} {prose(200 + i, 10)}</div>") for i in range(40)]
    rows += [(50, None, f"<p>{menu}"), (51, "http://lone.example/", f"<p>{menu}"), (52, "http://h0.example/", None), (None, "http://h1.example/", "<p>hello")]
    rows += [(53, "http://copy.example/a", f"<p>{prose(5, 40)}"), (53, "http://copy.example/b", f"<p>{prose(5, 40)}")]
    for shard in (4 << 20, 1500):
        got = {}
        for r in html_text.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int"), shard=shard).collect():
            got.setdefault(r.page_id, []).append(r)
            assert r.n_chars == len(r.text)
        for i in range(40):
            text = got[i][0].text
            if shard > 1500:
                assert text == f"{prose(100 + i, 60)}\n\np{i} {prose(200 + i, 10)}"
            assert prose(100 + i, 60) in text
        assert got[50][0].text == got[51][0].text == menu and got[52][0].text == "" and got[None][0].text == "hello"
        assert [r.text for r in got[53]] == [prose(5, 40)] * 2
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_and_large_shards_give_the_same_texts(spark):
    rows = []
    for i in range(48):  # a section template on one or two of 48 pages, a line in and outside articles, equal pages with unlike html
        template, line, own = prose(300 + i // 3, 20), prose(400, 14), prose(500 + i, 50)
        rows.append((i, f"http://hot.example/{i}", f"<div>{template}</div><div>{own}</div>" if i % 2 else f"<p>{line if i % 4 else ''}</p><article><p>{own}<p>{line}</article>"))
        rows.append((100 + i, f"http://hot.example/copy{i}", f"<script>{i}</script><p>{prose(600, 40)}</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    large, small = ({r.page_id: tuple(r) for r in html_text.extract(pages, shard=size).collect()} for size in (4 << 20, 700))
    assert len(large) == len(rows) and large == small
    assert all(large[i][2] == f"{prose(500 + i, 50)}\n\n{prose(400, 14)}" for i in range(0, 48, 2))
    assert all(large[i][2] == prose(500 + i, 50) for i in range(48) if i % 2 and i // 3 % 2)
    assert all(large[i][2] == f"{prose(300 + i // 3, 20)}\n\n{prose(500 + i, 50)}" for i in range(48) if i % 2 and i // 3 % 2 == 0)
    assert all(large[100 + i][2] == prose(600, 40) for i in range(48))


def test_streams_exchange_few_bytes():
    h = np.unique(np.random.default_rng(4).integers(0, 1 << 48, 200_000).astype(np.uint64))
    packed = html_text._packed(h)
    assert np.array_equal(html_text._unpacked(packed), h) and len(packed) < 5 * len(h)
    assert len(html_text._unpacked(html_text._packed(h[:0]))) == 0
    own = np.setdiff1d(h[1::2], h[::2])
    first, second = html_text._shared([html_text._packed(h[::2]), html_text._packed(np.sort(np.concatenate([own, h[:4:2]])))])
    assert np.array_equal(html_text._unpacked(first), h[:4:2]) and first == second


def test_copies_of_a_page_travel_once_and_come_back_each(spark, monkeypatch):
    monkeypatch.setattr(html_text, "COPIES", 7)
    page, big = f"<p>{prose(700, 40)}", (1 << 53) + 1
    rows = [(big + i if i else None, f"http://one.example/{i}" if i % 3 else "http://one.example/", page) for i in range(60)]
    rows += [(i, f"http://one.example/o{i}", f"<p>{prose(800 + i, 40)}") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for shard in (8 << 20, 900):
        got = html_text.extract(pages, shard=shard).collect()
        want = [(i, u, h[3:]) for i, u, h in rows]
        assert sorted(map(str, want)) == sorted(str((r.page_id, r.url, r.text)) for r in got)
        assert {r.n_repeated for r in got} == {0}


def test_repeats_against_all_substrings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 160))
        tokens, page = rng.integers(0, 3, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        stop = np.searchsorted(page, page, side="right")
        where = {}
        for i in range(n - 3):
            if page[i] == page[i + 3]:
                where.setdefault(tuple(tokens[i:i + 4]), []).append(i)
        want = np.zeros(n, bool)
        for at in where.values():
            if len({page[i] for i in at}) > 1:
                for i in at:
                    want[i:i + 4] = True
        assert np.array_equal(html_text.repeated(tokens, page, stop, 4), want)


def test_extraction_on_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    import html
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    """The base spans by Python's own regular expressions."""
    out = []
    for kind, pattern, ok in (
            (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
            (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def _digest(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = ["a.b+c@d-e.f.g, x@y, @z.com a@b.c_d@e.f.g. p@q..r", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 1 2  3",
         "+1 (555) 123-4567 +12345678 + 1 +1+22 333 444 555 +123456789012345678", "😀é 10.0.0.1 😀 me@x.example +44 20 7946 0958", "9" * 3000, "a@b" + ".c" * 5000,
         "a" * 20000, "1 " * 6000, "+1" + " " * 5000 + "2", "", None, "x@y.z" * 40, "+1 4111 1111 1111 1111", "1-1-1-1-1-1-1-1-1-1-1-1-1"]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, base string")


def test_base_spans_against_python(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("0123456789.@+- ()ab"), 80)) for _ in range(200)]
    for r in pii.find(_docs(spark, texts)).collect():
        want = _base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(_digest(want).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in want) for x in range(4))
        assert not want or set(_digest(want).split(",")) <= set(r.spans.split(","))


def test_labelers_add_spans_and_leave_others(spark):
    texts = [f"please call {200 + i % 700} 555 {1000 + i} about it" for i in range(60)] + [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ok' for i in range(60)]
    texts += [f"order #{10**8 + i} shipped on 2024-01-{10 + i % 20} at 12 30 45 page {i}" for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.find(_docs(spark, texts)).collect()}
    assert all(re.fullmatch(r"account:12:24", got[i]) for i in range(60))
    assert all(re.fullmatch(r"secret:9:49", got[i]) for i in range(60, 120))
    assert all(got[i] == "" for i in range(120, 180))


def test_em_tells_good_labelers_from_bad():
    rng = np.random.default_rng(0)
    votes = Counter()
    for _ in range(4000):
        y = 1 if rng.random() < 0.4 else -1
        votes[tuple(int(y if rng.random() < p else -y) if rng.random() < 0.7 else 0 for p in (0.95, 0.9, 0.55))] += 1
    prior, odds = pii.reliabilities(sorted(votes.items()))
    assert 0.3 < prior < 0.5 and odds[0][1] > odds[2][1] and odds[1][1] > odds[2][1] and abs(odds[2][1]) < 0.8


def test_redaction(spark, odd_documents, no_documents):
    got = [r.text for r in pii.redact(_docs(spark, TEXTS)).collect()]
    assert got[1] == "[IP].[IP] 256.1.1.1 [IP] 1.2.3" and got[4] == "😀é [IP] 😀 [EMAIL] [PHONE]" and got[10:12] == ["", None]
    for before, after in zip(TEXTS, got):
        spans = _base(before or "")
        assert (before == after) if not spans else all(before[a:b] not in after or k == 2 for a, k, b in spans[:3] if b - a > 8)
    out = pii.redact(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    text = next(r.text for r in out.collect() if r.doc_id == 12)
    assert text == "mail me at [EMAIL] or [PHONE] from [IP], card [CARD]."
    assert pii.redact(no_documents).count() == 0 and pii.find(no_documents).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 400_000
    rows = [(1, "http://a/ b\r\n", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big), (0, "v", big),
            (None, "u", big), (None, "u", "y" * 300), (None, "u", "y" * 300), (1, "again", "<p>" + "x" * 200), (8, "u", "a" * 100), (9, "u", "a" * 100), (10, "u", "b" * 99), (11, "u", "b" * 99)]
    pages = spark.createDataFrame([(*r, "zz") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=2000)
    assert archives.count() > 1
    payload = {}
    for r in warc.read_archives(archives, with_payload=True).collect():
        assert r.verified or r.record_type == "revisit"
        payload.setdefault((r.page_id, r.payload_digest), []).append(r)
    small = lambda h: len((h or "").encode()) < 100
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        r = payload[page_id, hashlib.sha256(body).hexdigest()].pop()
        assert r.payload_bytes == len(body)
        if small(html) or not same or page_id == min(same):
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == body
        else:
            assert r.record_type == "revisit" and r.refers_to == min(same) and r.payload is None
    assert not any(payload.values())
    for f in tmp_path.glob("*.warc.gz"):  # any gzip reader sees the members joined
        assert gzip.open(f).read().count(b"WARC/1.1\r\n") >= 2
    assert warc.archive(pages).count() == len(rows) and warc.archive(pages.where("false")).count() == 0


def test_broken_archives_are_told():
    whole = warc.page_record(1, "u", b"payload" * 50, "0" * 64, 350, None)
    assert [n for *_, n in warc.records(io.BytesIO(whole + whole))] == [350, 350]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-20])))
    short = gzip.compress(gzip.decompress(whole).replace(b"payload", b"paylod", 1))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(short)))
    assert warc.record_id(1) == warc.record_id(1) and uuid.UUID(warc.record_id(2)[10:-1])
