"""Packing documents into training sequences by best-fit decreasing.

A document is tokenized and ended by an end id; one longer than a window is first cut into full windows,
which are sequences of their own. The remaining pieces, one per document at most, are dealt at random
over shards of bounded size, and every shard is packed by best-fit decreasing: a segment tree over the
remaining capacity of the open windows finds the tightest one that takes the piece. Pieces travel as
numbers only (start, length, checksum); the texts are never shuffled. A text of any length is tokenized
whole, word by word.

Defined cases: a null or empty text is the end id alone; rows are packed one by one, so repeated rows
are repeated; a null doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairmeter.llm.common import batches_by_bytes, give_back, read, stage

WINDOW, END = 2048, 1
#: Pieces that one task packs; only the last few windows of a shard are not full.
SHARD = 50_000
#: Bytes that a Python worker holds for words already seen, in each of two generations.
HELD_BYTES = 40 << 20
#: A mark between a letter and white space: the vocabulary's pre-tokenizer cuts there in any case.
_MARK = re.compile(rb"[.,;:!?](?<=[a-z].)(?!\S)")


class WordIds:
    """Token ids of texts, with those of the words seen lately at hand.

    The vocabulary drops white space and joins nothing across it, so a text's ids are those of its
    white-space-separated words, one after the other. A mark at the end of a word is a word of its own, and
    A to Z count as lower case, as the vocabulary has it; but for texts that may spell out a special token,
    which holds and strips no white space and gets its id, as in the tokenizer's own call. The table of words
    is kept from task to task; a full one becomes the older one, from which a word still in use moves over,
    so rare words go first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.held, self.older, self.size = {}, {}, 0

    def encode(self, texts):
        """(ids of all texts in one array, number of ids per text)."""
        data = self.ids_of(texts)
        return np.frombuffer(b"".join(data), "<u4").astype(np.int64), np.array([len(x) // 4 for x in data], np.int64)

    def ids_of(self, texts) -> list:
        """The ids of every text as little-endian 32-bit integers, in bytes."""
        split = []
        for t in texts:
            data = (t or "").encode("utf-8", "replace")
            split.append((data if b"<|" in data else _MARK.sub(rb" \g<0>", data.lower())).split())
        parts = [list(map(self.held.get, words)) for words in split]
        gaps = [i for i, p in enumerate(parts) if None in p]
        unseen = {w for i in gaps for w, x in zip(split[i], parts[i]) if x is None}
        known = {w: self.older[w] for w in unseen if w in self.older}
        new = list(unseen.difference(known))
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in new], add_special_tokens=False)):
            ids = e.ids
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        self.held.update(known)
        self.size += sum(map(len, known)) + sum(map(len, known.values())) + 180 * len(known)
        for i in gaps:
            parts[i] = [known[w] if x is None else x for w, x in zip(split[i], parts[i])]
        if self.size > HELD_BYTES:
            self.older, self.held, self.size = self.held, {}, 0
        return [b"".join(p) for p in parts]


_TOKENIZERS = {}


def _word_ids(path):
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False, hold: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full windows and one rest per document.

    ``hold``: whether a worker keeps its words for its next task; without, it gives the memory back, which a
    job with other hungry stages may want.
    """
    def cut(frames):
        encoder, last, wide = _word_ids(path), np.array([end], "<u4").tobytes(), 4 * window
        for f in batches_by_bytes(frames, "text", 2 << 20):
            out = []
            for doc, ids in zip(f["doc_id"], encoder.ids_of(f["text"])):
                ids += last
                for s in range(0, len(ids), wide):
                    part = ids[s:s + wide]
                    out.append((doc, s // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            pdf = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf
        if not hold:
            _TOKENIZERS.pop(path, None)
            del encoder
            give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def best_fit_decreasing(lengths, window: int = WINDOW):
    """(window number, offset) of every length, the lengths given in falling order."""
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)  # open windows below each node; leaf: those with just that much room
    open_at = [[] for _ in range(window + 1)]
    number, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def put(room, which):
        open_at[room].append(which)
        i = size + room
        while i:
            tree[i] += 1
            i >>= 1

    for k, length in enumerate(lengths):
        i = size + length
        while not tree[i]:  # the next node to the right, at any height, that holds a window
            while i & (i + 1) and i & 1:
                i >>= 1
            if not i & (i + 1):  # the right edge: no open window has that much room
                i = 1
                break
            i += 1
        if i > 1:
            while i < size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            room = i - size
            which = open_at[room].pop()
            while i:
                tree[i] -= 1
                i >>= 1
        else:
            which, room, n = n, window, n + 1
        number[k], offset[k] = which, window - room
        if room > length:
            put(room - length, which)
    return number, offset


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False, hold: bool = True) -> DataFrame:
    """Every piece with its sequence and its place there."""
    rows = stage(pieces(docs, path, window, end, with_ids, hold).withColumn("at", F.monotonically_increasing_id()))
    rest = rows.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // SHARD))
    columns = [f for f in rows.schema.fields if f.name != "at"]
    names = [f.name for f in columns]

    def place(key, pdf):
        # equal pieces are interchangeable: the order below makes a second run agree
        pdf = pdf.sort_values(["length", "doc_id", "start", "at"], ascending=[False, True, True, True])
        number, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        return pdf[names].assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, offset long"
    packed = rest.groupBy(F.pmod(F.xxhash64("at"), F.lit(shards)).alias("shard")).applyInPandas(place, schema)
    full = rows.where(F.col("length") == window).select(
        *names, (F.lit(1 << 62) + F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens): the pieces of every sequence joined, padded to the window unless the
    sequence's length is a power of two. Takes what ``pack(with_ids=True)`` returns."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size(ids)
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(window) - n)
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), missing)).alias("ids"), n.alias("tokens"))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_path())
