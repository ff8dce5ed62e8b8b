"""Main text of web pages by suffix arrays over the pages of a host.

The text blocks of a host's pages are laid out as one stream of tokens. A suffix array of the stream,
sorted on the first ``LONG`` tokens of every suffix, brings equal long substrings together; those that
occur on two distinct pages are repeats. Pages are parsed where they lie. A host with more than ``SHARD``
characters of html is dealt to streams by what the pages say, so that equal pages meet in one, and the
streams exchange the hashes of their distinct substrings: what stands in two streams stands on two distinct
pages, and is a repeat in every stream. A batch sends a host's pages to a stream in one compressed row, equal
ones once.

Markup then checks the outcome. What stands in navigation, header, footer, aside, form, script or style
elements, or is marked as advert, notice, sidebar or comment, goes, repeated or not: a template shown
once cannot be seen as one. What stands in the article or main element stays, repeated or not: a text
that several pages carry is not template. Blocks that markup says nothing about lose their covered runs
and keep their unique ones, if their page has no article.

Defined cases: a null or empty html gives an empty text; unclosed elements, comments, scripts and tags
cut off by the end of the page close there; end tags without a start are ignored; a page without a host
is its own host; equal pages of a host count as one page; rows that repeat a page_id are pages of their
own; an empty table gives no rows; extra columns are ignored.
"""

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.llm.common import batches_by_bytes, mix64, read, stage, text_buffer, word_hashes

LONG, SHARD = 8, 8 << 20
#: Characters of html parsed before rows are sent, and equal pages that one row of the result stands for.
BATCH, COPIES = 4 << 20, 1000
KINDS = {"a": "article", "f": "furniture", "o": "open"}

# Elements and marks of page furniture, raw-text elements, void and inline elements.
FURNITURE = set("nav header footer aside form script style noscript template svg iframe button select option textarea head title dialog menu "
                "object canvas audio video map fieldset".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr img br".split())
MARKS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar "
            "footer header masthead comment comments disqus reply replies cookie cookies consent gdpr notice notices alert newsletter subscribe signup "
            "social share sharing related recommended breadcrumb breadcrumbs popup modal overlay widget pagination pager skip login".split())
# Words that only say where furniture stands or how it is boxed, marks that also head an article, and elements apart from the main text.
PLACES = set("user site page main global top bottom left right primary secondary mobile desktop sticky container wrapper wrap list section area "
             "box block bar inner outer links link items item content slot unit x".split())
HEADS = set("header masthead banner".split())
APART = set("nav aside footer dialog menu template noscript svg".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|([^<]+|<)", re.S)
# whole name=value pairs, so that no value and no part of a longer name is taken for an attribute
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s\"'>]++))?")
_SPACES = re.compile(r"\s+")


def _is_mark(token: str, in_article: bool) -> bool:
    """Whether a class word or an id names page furniture: every part is a mark or says where it stands."""
    parts = [p for p in re.split(r"[-_]+", re.sub(r"[0-9]+", "", token)) if p]
    marks = MARKS.intersection(parts)
    return bool(marks) and marks.union(PLACES).issuperset(parts) and not (in_article and marks <= HEADS)


def _is_furniture(tag: str, attributes: list, in_article: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True
    for name, value in attributes:
        if (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
                or name == "role" and value in ROLES
                or name in ("class", "id") and tag not in ("body", "html", "article", "main") and any(_is_mark(t, in_article) for t in value.split())):
            return True
    return False


def _attributes(text: str) -> list:
    return [(name.lower(), value.strip("\"'").strip().lower()) for name, value in _ATTRIBUTE.findall(text)] if text else []


def blocks(page: str) -> list:
    """(text, kind) of every block in page order; kind is "article", "furniture" or "open".

    An element that holds the page's main element, or its only article, is not furniture. That is known
    at the end of a page, which is then read once more.
    """
    out, seen, holders = _blocks(page, frozenset())
    return _blocks(page, holders)[0] if holders and not seen else out


def _blocks(page: str, spared: frozenset) -> tuple:
    """The blocks, whether an article or main element stands outside furniture, and the places of the
    furniture elements around the others; elements that start at a place in ``spared`` are no furniture."""
    out, words, stack = [], [], []
    furniture = article = 0
    raw, seen = None, False
    inside = {}  # start of a furniture element -> its tag, and the main and article elements in it

    def flush():
        text = _SPACES.sub(" ", entities.unescape("".join(words))).strip()
        words.clear()
        if text:
            out.append((text, "furniture" if furniture else "article" if article else "open"))

    at, n = 0, len(page)
    while at < n:
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            raw = None
            continue
        m = _TOKEN.match(page, at)
        start, at = at, m.end()
        if m[4] is not None:
            words.append(m[4])
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                words.append(" " if tag == "br" else "")
                continue
            if m[1] or not m[3] or start in spared or not _is_furniture(tag, _attributes(m[3]), bool(article)):
                if m[1] and any(s[0] == tag and s[3] for s in stack[-1:]):
                    flush()
                    _, f, a, _, _ = stack.pop()
                    furniture, article = furniture - f, article - a
                continue
            flush()  # an inline element marked as furniture
            stack.append((tag, 1, 0, True, start))
            furniture += 1
            continue
        flush()
        if tag in VOID:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for _, f, a, _, _ in stack[k:]:
                        furniture, article = furniture - f, article - a
                    del stack[k:]
                    break
            continue
        if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            _, f, a, _, _ = stack.pop()
            furniture, article = furniture - f, article - a
        if m[3].endswith("/") and tag in FURNITURE:
            continue
        attributes = _attributes(m[3])
        main = tag == "main" or ("role", "main") in attributes
        f, a = int(start not in spared and _is_furniture(tag, attributes, bool(article))), int(main or tag == "article")
        if a and not f:
            seen = seen or not furniture
            for t, held, _, _, place in stack:
                if held:
                    inside.setdefault(place, (t, []))[1].append(main)
        stack.append((tag, f, a, False, start))
        furniture, article = furniture + f, article + a
        if tag in RAW:
            raw = tag
    flush()
    holders = frozenset(p for p, (t, held) in inside.items() if any(held) or len(held) == 1 and t not in APART)
    return out, seen, holders


def _substrings(tokens: np.ndarray, stop: np.ndarray, long: int):
    """Starts of the substrings of ``long`` tokens inside a block, and a number that equal ones share.

    ``stop`` is the end of each token's block. The suffix array is built by prefix doubling up to ``long``
    tokens: suffixes with equal rank then share at least that much.
    """
    n = len(tokens)
    if n < long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    width, here = 1, np.arange(n)
    while width < long:
        step = min(width, long - width)
        other = np.where(here + step < n, rank[np.minimum(here + step, n - 1)], 0)
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + other, return_inverse=True)
        width += step
    whole = np.flatnonzero(here + long <= stop)
    return whole, np.unique(rank[whole], return_inverse=True)[1] if len(whole) else whole


def _ends(run: np.ndarray, page: np.ndarray):
    """The lowest and the highest page of each run of equal substrings."""
    n = int(run.max()) + 1 if len(run) else 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, run, page)
    np.maximum.at(high, run, page)
    return low, high


def _cover(starts: np.ndarray, n: int, long: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + long, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, stop: np.ndarray, long: int = LONG) -> np.ndarray:
    """Marks the tokens inside a substring of at least ``long`` tokens that occurs on two distinct pages."""
    at, run = _substrings(tokens, stop, long)
    low, high = _ends(run, page[at])
    return _cover(at[(low < high)[run]], len(tokens), long)


class Stream:
    """Pages (lists of blocks) of a host, all or a part of them."""

    def __init__(self, parsed: list, long: int = LONG):
        self.parsed, self.long = parsed, long
        self.flat = [(k, text, kind) for k, page in enumerate(parsed) for text, kind in page]
        buf, starts = text_buffer([t for _, t, _ in self.flat])
        h, first = word_hashes(buf)
        self.bound = np.searchsorted(first, starts)
        sizes = np.diff(self.bound)
        # equal pages are one page: they share their number
        same = {}
        number = [same.setdefault(tuple(p), k) for k, p in enumerate(parsed)]
        page = np.repeat(np.array([number[k] for k, _, _ in self.flat], np.int64), sizes)
        self.tokens, self.n = mix64(h), len(h)
        self.at, self.run = _substrings(self.tokens, np.repeat(self.bound[1:], sizes), long)
        self.low, self.high = _ends(self.run, page[self.at])
        self.repeat = self.low < self.high  # of every distinct substring

    def hashes(self) -> np.ndarray:
        """64-bit hash of every distinct substring."""
        start = np.zeros(len(self.repeat), np.int64)
        start[self.run] = self.at
        g = np.zeros(len(start), np.uint64)
        for k in range(self.long):
            g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + self.tokens[start + k])
        return g

    def learn(self, hashes: np.ndarray):
        """Takes the substrings that are repeats in the whole host, by the upper 48 bits of their hashes."""
        self.repeat |= np.isin(self.hashes() >> np.uint64(16), hashes)

    def texts(self) -> list:
        """(text, tokens, repeated tokens) of every page."""
        cover = _cover(self.at[self.repeat[self.run]], self.n, self.long)
        out = [[[], 0, 0] for _ in self.parsed]
        marked = [any(kind == "article" for _, kind in p) for p in self.parsed]
        for (k, text, kind), a, b in zip(self.flat, self.bound[:-1], self.bound[1:]):
            gone = cover[a:b]
            out[k][1] += int(b - a)
            out[k][2] += int(gone.sum())
            if kind == "furniture" or kind == "open" and marked[k]:
                continue
            if kind == "article" or not gone.any():
                out[k][0].append(text)
                continue
            run = []
            for w, c in [*zip(re.findall(r"[^\x20\x09-\x0D]+", text), gone), ("", True)]:
                if not c:
                    run.append(w)
                elif run:
                    out[k][0].append(" ".join(run))
                    run = []
        return [("\n\n".join(t), n, r) for t, n, r in out]


def host_texts(pages: list, long: int = LONG) -> list:
    """(text, tokens, repeated tokens) of every page (html) of one host."""
    return Stream([blocks(h) for h in pages], long).texts()


# Substrings that streams exchange: the upper 48 bits of their hashes, in order, as the gaps between them in
# planes of bytes.

def _packed(values: np.ndarray) -> bytes:
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    x = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(6, -1)
    gaps = np.zeros((x.shape[1], 8), np.uint8)
    gaps[:, :6] = x.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def _parts(stream: Stream, parts: int):
    """(part, packed substrings) of a stream; equal substrings fall into the same part of the host, the
    remainder of their hash, and travel as its quotient."""
    g = np.unique(stream.hashes() >> np.uint64(16))
    g, part = g // np.uint64(parts), g % np.uint64(parts)
    for k in np.unique(part):
        yield int(k), _packed(g[part == k])


def _shared(packed: list):
    """For one part of a host: the substrings of each stream that stand in two streams, packed, or None."""
    lists = [_unpacked(p) for p in packed]
    g, n = np.unique(np.concatenate(lists), return_counts=True)
    several = g[n > 1]
    for h in lists:
        h = h[np.isin(h, several)]
        yield _packed(h) if len(h) else None


# Pages of a host that travel together. White space in a block is one space, so these marks stand in none.
_BLOCK, _PAGE = "\n", "\x1e"


def _bundle(pages: dict) -> tuple:
    """(size, compressed text) of distinct pages (kinds, text): the kinds first, then the texts."""
    data = _PAGE.join([_BLOCK.join(k for k, _ in pages), *(t for _, t in pages)]).encode("utf-8", "surrogatepass")
    return len(data), pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _opened(size: int, data: bytes) -> list:
    """The (kinds, text) of a bundle's pages."""
    kinds, *texts = pa.Codec("zstd").decompress(data, size, asbytes=True).decode("utf-8", "surrogatepass").split(_PAGE)
    return [*zip(kinds.split(_BLOCK), texts)]


def host(url):
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*+://([^/?#]*+)", 1)), F.lit("")), F.lit("-"))


def extract(pages: DataFrame, long: int = LONG, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text, n_chars, n_tokens, n_repeated) of every page."""
    p = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("host", host(F.col("url")))
    p = p.withColumn("host", F.when(F.col("host") == "-", F.concat(F.lit("-"), F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("page_id", F.lit("")))).otherwise(F.col("host")))
    shards = F.ceil(F.sum(F.length("html")) / shard).cast("int")
    large = stage(p.groupBy("host").agg(shards.alias("shards")).where("shards > 1"))
    rows = p.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))

    def parse(frames):
        for f in frames:
            for g in batches_by_bytes([f], "html", BATCH):
                bundles = {}  # (host, stream) -> its distinct pages, and the rows that have them
                for at, (page, host, n) in enumerate(zip(g["html"], g["host"], g["shards"])):
                    found = blocks(page)
                    x = "".join(kind[0] for _, kind in found), _BLOCK.join(t for t, _ in found)
                    nth = 0
                    if n > 1:
                        nth = int.from_bytes(hashlib.blake2b("\0".join(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % n
                    bundles.setdefault((host, nth), {}).setdefault(x, []).append(at)
                out = []
                ids, urls, n = g["page_id"].tolist(), g["url"].tolist(), g["shards"].tolist()
                for (host, nth), pages in bundles.items():
                    ats = [at for held in pages.values() for at in held]
                    out.append((host, nth, n[ats[0]], *_bundle(pages), [len(held) for held in pages.values()],
                                [ids[a] for a in ats], [urls[a] for a in ats]))
                yield pd.DataFrame(out, columns=["host", "nth", "shards", "size", "data", "held", "page_id", "url"])

    def stream(pdf):
        """The stream of the distinct pages, and the page_id and url of all pages, by distinct page."""
        same = {}
        for size, data, held, ids, urls in zip(pdf["size"], pdf["data"], pdf["held"], pdf["page_id"], pdf["url"]):
            ends = np.cumsum(held)
            for x, a, b in zip(_opened(size, data), ends - held, ends):
                same.setdefault(x, []).extend(zip(ids[a:b], urls[a:b]))
        return Stream([[*zip(t.split(_BLOCK), (KINDS[c] for c in k))] if k else [] for k, t in same], long), list(same.values())

    def texts(pdf, known=None):
        s, names = stream(pdf)
        if known is not None and len(known):
            parts = np.uint64(pdf["shards"].iloc[0])
            s.learn(np.concatenate([_unpacked(x) * parts + np.uint64(k) for k, x in zip(known["part"], known["packed"])]))
        out = [(t, len(t), n, r, [i for i, _ in have[a:a + COPIES]], [u for _, u in have[a:a + COPIES]])
               for (t, n, r), have in zip(s.texts(), names) for a in range(0, len(have), COPIES)]
        return pd.DataFrame(out, columns=["text", "n_chars", "n_tokens", "n_repeated", "page_id", "url"])

    def tell(key, pdf):
        parts = int(pdf["shards"].iloc[0])
        told = [*_parts(stream(pdf)[0], parts)] if parts > 1 else []
        return pd.DataFrame({"host": key[0], "nth": key[1], "part": [k for k, _ in told], "packed": [x for _, x in told]})

    def share(pdf):
        learnt = pdf[["host", "nth", "part"]].assign(packed=[*_shared(pdf["packed"].tolist())])
        return learnt[learnt["packed"].notna()]

    rows = rows.mapInPandas(parse, "host string, nth long, shards int, size long, data binary, held array<long>, page_id array<string>, url array<string>")
    rows = rows.groupBy("host", "nth")
    out = "text string, n_chars long, n_tokens long, n_repeated long, page_id array<string>, url array<string>"
    if large.isEmpty():
        found = rows.applyInPandas(lambda pdf: texts(pdf), out)
    else:
        told = rows.applyInPandas(tell, "host string, nth long, part long, packed binary")
        learnt = told.groupBy("host", "part").applyInPandas(share, "host string, nth long, part long, packed binary")
        found = rows.cogroup(learnt.groupBy("host", "nth")).applyInPandas(lambda pdf, known: texts(pdf, known), out)
    found = found.select("text", "n_chars", "n_tokens", "n_repeated", F.explode(F.arrays_zip("page_id", "url")).alias("page"))
    return found.select(F.col("page.page_id").cast("long").alias("page_id"), "page.url", "text", "n_chars", "n_tokens", "n_repeated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
