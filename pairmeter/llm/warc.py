"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Payloads of at least ``SMALLEST`` bytes that are equal are stored once: the record of the smallest
page_id is a response, the others revisit it. Which pages revisit is found on (page_id, digest) rows
alone. A task writes its pages to archives of bounded size in the folder named by spark.checkpoint.dir;
only archives named by a task that succeeded are read, so a task that runs again leaves no double
records. The reader keeps one chunk of compressed bytes and one of decompressed bytes at a time, frames
records by their Content-Length and compares the digest of every response payload with its header.

Defined cases: a null html is an empty payload; a null page_id is written as such and counts as larger
than any id (if all equal payloads lack an id, all are responses); repeated rows with the smallest id
are all responses; a null url has no target header, control characters in one are percent-encoded; an
empty table gives no archives and no rows; extra columns are ignored.
"""

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.llm.common import read, stage
from pairmeter.plans.staging import session_dir

SMALLEST = 100
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18


def _open(path: str, mode: str):
    fs, where = pyarrow.fs.FileSystem.from_uri(path)
    # the members are compressed here: the file name must not start a second compression
    return fs.open_input_stream(where, compression=None) if mode == "r" else fs.open_output_stream(where, compression=None)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _member(headers: list, blocks: list) -> bytes:
    """A record as one gzip member."""
    length = sum(map(len, blocks))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", length)]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([z.compress(head.encode("utf-8")), *(z.compress(b) for b in blocks), z.compress(b"\r\n\r\n"), z.flush()])


def page_record(page_id, url, payload, digest: str, n_bytes: int, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if refers_to is None:
        return _member(headers, [http, payload])
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    return _member(headers, [http])


class _Member:
    """The decompressed bytes of one gzip member, chunk by chunk."""

    def __init__(self, source, rest: bytes):
        self.source, self.inflate, self.waiting, self.ready = source, zlib.decompressobj(31), rest, b""

    def more(self) -> bytes:
        while not self.inflate.eof:
            data = self.waiting or self.source.read(CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            out = self.inflate.decompress(data, CHUNK)
            self.waiting = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def head(self) -> bytes:
        """Bytes up to an empty line."""
        while b"\r\n\r\n" not in self.ready:
            data = self.more()
            if not data:
                raise ValueError("a record has no end of headers")
            self.ready += data
        head, _, self.ready = self.ready.partition(b"\r\n\r\n")
        return head

    def take(self, n: int):
        while n:
            data = self.ready or self.more()
            if not data:
                raise ValueError("a record is shorter than its Content-Length")
            yield data[:n]
            self.ready, n = data[n:], n - len(data[:n])

    def close(self) -> bytes:
        """Reads to the member's end, which must be the record's; returns the bytes after it."""
        tail = self.ready
        while data := self.more():
            tail += data
        if tail != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        return self.inflate.unused_data


def _fields(head: bytes) -> dict:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(source, with_payload: bool = False):
    """(headers, http headers, payload or None, payload digest, payload bytes) of every record in a stream."""
    rest = source.read(CHUNK)
    while rest:
        m = _Member(source, rest)
        head = _fields(m.head())
        left, http, payload, digest, n = int(head["content-length"]), {}, [], hashlib.sha256(), 0
        if head.get("content-type", "").startswith("application/http"):
            raw = m.head()
            http, left = _fields(raw), left - len(raw) - 4
        for block in m.take(left):
            digest.update(block)
            n += len(block)
            if with_payload:
                payload.append(block)
        rest = m.close() or source.read(CHUNK)
        yield head, http, b"".join(payload) if with_payload else None, digest.hexdigest(), n


def revisits(keys: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat another's payload."""
    large = keys.where(F.col("n_bytes") >= smallest)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (large.join(first, "digest").where("refers_to is not null and (page_id is null or page_id > refers_to)")
                 .select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages (page_id, url, html) below ``folder``; (path, n_records) of every archive."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"digest": F.sha2("html", 256), "n_bytes": F.octet_length("html").cast("long")})
    again = stage(revisits(stage(base.select("page_id", "digest", "n_bytes"))))
    on = F.col("b.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("b.digest") == F.col("r.digest"))
    rows = base.alias("b").join(again.alias("r"), on, "left").select(
        "b.page_id", "b.url", "b.digest", "b.n_bytes", "r.refers_to", F.when(F.col("r.refers_to").isNull(), F.encode("b.html", "UTF-8")).alias("payload"))

    def write(frames):
        out, path, n, size = None, None, 0, 0
        for f in frames:
            for page_id, url, digest, n_bytes, refers_to, payload in zip(*(f[c] for c in f.columns)):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                       ("Content-Type", "application/warc-fields")], [b"format: WARC File Format 1.1\r\n"]))
                plain = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                member = page_record(plain[0], url, payload, digest, int(n_bytes), plain[1])
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "n_records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    return stage(rows.mapInPandas(write, "path string, n_records long"))


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per page record of the archives in ``archives(path)``; ``verified`` is null for a revisit,
    which holds no payload."""
    def scan(frames):
        for f in frames:
            for path in f["path"]:
                rows = []
                with _open(path, "r") as source:
                    for head, http, payload, digest, n in records(source, with_payload):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        stated, length = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                        whole = head["warc-type"] == "response"
                        number = [int(x) if (x := head.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page")]
                        rows.append((path, number[0], head.get("warc-target-uri"), head["warc-type"], length, stated, number[1],
                                     stated == digest and length == n if whole else None, payload if whole else None))
                        if len(rows) >= (64 if with_payload else 4096):
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    n = max(1, min(archives.count(), 10 * archives.sparkSession.sparkContext.defaultParallelism))
    return archives.select("path").repartition(n, "path").mapInPandas(
        scan, "path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
              "refers_to long, verified boolean, payload binary")


def _frame(rows):
    f = pd.DataFrame(rows, columns=["path", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "verified", "payload"])
    return f.astype({"page_id": "Int64", "refers_to": "Int64", "verified": "boolean"})


def archive(pages: DataFrame) -> DataFrame:
    """Writes archives to the application's folder below the shared one, which goes with it, and returns their records as read back; a record whose payload
    does not match its digest stops the query."""
    spark = pages.sparkSession
    folder = f"{session_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = "file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    fs, where = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)
    back = read_archives(write_archives(pages, folder))
    sound = F.when(F.coalesce("verified", F.lit(True)), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest in "), "path")))
    return back.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(read(spark, sf_dir, "pages"))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.*, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
