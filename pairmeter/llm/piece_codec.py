"""Encoding and decoding with a merge-type piece vocabulary, equal to the sentencepiece library.

A text becomes its space mark, then its characters, spaces written as marks. Adjacent symbols that form a
piece wait in an agenda ordered by the piece's score, then by place; the best pair is merged, its new
neighbours enter, and entries whose symbols have changed meanwhile are skipped. A symbol that is no piece
is written as its UTF-8 bytes.

No merge ever crosses two characters that stand next to each other in no piece, so a text is first cut at
all such places. The cuts are exact for any vocabulary of this kind (they follow from the pieces alone),
and make most of a text a sequence of chunks seen before, whose ids are held in a table of bounded size. The
short chunks a batch brings in anew are merged together, one merge of every chunk a round.

Every Arrow batch is checked against the library, encoding and decoding alike; a difference (a model of
another type, another normaliser, a changed library) raises an error and is never written.

Defined cases: a null text is empty; an empty text has only the begin and end ids and decodes to an empty
text; whole texts of any length are encoded, one without cuts costs n log n; rows are handled one by one,
so repeated rows, ties and null ids stay as they are; an empty table gives no rows; ``encode`` keeps other
columns as they are, but for those named like its outputs, which it replaces.
"""

import codecs
import hashlib
import heapq
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairmeter.llm.common import batches_by_bytes, read

MARK = "▁"
#: Chunks whose ids a Python worker holds, in each of two generations, and the longest chunk it holds.
HELD, LONGEST = 250_000, 64
#: The longest chunk that is merged together with others.
SHORT = 48

codecs.register_error("one_each", lambda e: ("�" * (e.end - e.start), e.end))


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [lib.id_to_piece(i) for i in range(len(lib))]
        plain = [i for i in range(len(lib)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.scores = {names[i]: -lib.get_score(i) for i in plain}
        self.ids = {names[i]: i for i in plain}
        self.bytes = {int(names[i], 16) if names[i].startswith("0x") else int(names[i][1:-1], 16): i for i in range(len(lib)) if lib.is_byte(i)}
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        surface = {i: names[i].replace(MARK, " ").encode("utf-8") for i in plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface = [surface.get(i, b"") for i in range(len(lib))]
        self.surface[lib.unk_id()] = " ⁇ ".encode("utf-8")
        self.marked = {i for i in plain if names[i].startswith(MARK)}

        inside = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.width = len(inside) + 1
        self.kind = np.zeros(0x110000, np.int64)
        self.kind[[ord(c) for c in inside]] = np.arange(1, self.width)
        self.together = np.zeros(self.width * self.width, bool)
        for p in self.ids:
            k = self.kind[[ord(c) for c in p]]
            self.together[k[:-1] * self.width + k[1:]] = True
        self.held, self.older = {}, {}

        symbols = self.ids | {c: len(lib) + k for k, c in enumerate(c for c in inside if c not in self.ids)}
        self.known, self.base = len(lib), len(lib) + len(inside)
        self.symbol = np.full(0x110000, self.base, np.int64)  # the base itself: a character that never merges
        self.symbol[[ord(c) for c in symbols if len(c) == 1]] = [i for c, i in symbols.items() if len(c) == 1]
        halves = sorted((symbols[p[:k]] * (self.base + 1) + symbols[p[k:]], i) for p, i in self.ids.items()
                        for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pairs, self.joins = np.array(halves, np.int64).reshape(-1, 2).T.copy()
        self.cost = np.full(self.base + 1, np.inf)
        self.cost[list(self.ids.values())] = [self.scores[p] for p in self.ids]

    def merged(self, chunk: str) -> list:
        """The pieces of a chunk by the agenda of adjacent pairs."""
        symbols, scores, n = list(chunk), self.scores, len(chunk)
        agenda = [(scores[p], i, i + 1, p) for i in range(n - 1) if (p := chunk[i:i + 2]) in scores]
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            far, near = after[right], before[left]
            after[left] = far
            if far < n:
                before[far] = left
                wider = piece + symbols[far]
                if wider in scores:
                    heapq.heappush(agenda, (scores[wider], left, far, wider))
            if near >= 0:
                wider = symbols[near] + piece
                if wider in scores:
                    heapq.heappush(agenda, (scores[wider], near, left, wider))
        return [s for s in symbols if s]

    def chunk_ids(self, chunk: str) -> bytes:
        out = []
        for s in self.merged(chunk):
            i = self.ids.get(s)
            out.extend([i] if i is not None else [self.bytes[b] for b in s.encode("utf-8")])
        return np.array(out, "<i4").tobytes()

    def joined_pairs(self, left, right):
        """The symbol each pair joins to, and its score; infinite for a pair that is no piece."""
        key = left * (self.base + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        to = self.joins[at]
        return to, np.where(self.pairs[at] == key, self.cost[to], np.inf)

    def ids_together(self, chunks: list) -> list:
        """As ``chunk_ids`` of every chunk: each round makes the best merge, the leftmost of equals, of every
        chunk that has one left."""
        if not chunks or not len(self.pairs):
            return [self.chunk_ids(c) for c in chunks]
        x = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.array([len(c) for c in chunks], np.int64)
        number, out = np.arange(len(chunks)), [None] * len(chunks)
        to, score = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        to[:-1], score[:-1] = self.joined_pairs(x[:-1], x[1:])
        score[np.cumsum(size) - 1] = np.inf
        while len(x):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(score, first)
            done = np.isinf(best)
            if done.any():
                over = np.repeat(done, size)
                ends = np.cumsum(size[done]).tolist()
                data, spelt = x[over].astype("<i4").tobytes(), np.logical_or.reduceat(x[over] >= self.known, [0, *ends[:-1]])
                for k, a, b, plain in zip(number[done].tolist(), [0, *ends], ends, (~spelt).tolist()):
                    out[k] = data[4 * a:4 * b] if plain else self.chunk_ids(chunks[k])
                x, to, score = x[~over], to[~over], score[~over]
                size, number, best = size[~done], number[~done], best[~done]
                continue
            at = np.flatnonzero(score == np.repeat(best, size))
            at = at[np.searchsorted(at, first)]
            x[at] = to[at]
            kept = np.ones(len(x), bool)
            kept[at + 1] = False
            x, to, score = x[kept], to[kept], score[kept]
            at -= np.arange(len(at))
            size -= 1
            last = np.cumsum(size) - 1
            behind = at[at < last]
            score[at] = np.inf
            to[behind], score[behind] = self.joined_pairs(x[behind], x[behind + 1])
            before = at[at > last - size + 1] - 1
            to[before], score[before] = self.joined_pairs(x[before], x[before + 1])
        return out

    def encode(self, texts) -> list:
        """The ids of every text, with the begin and end ids, as arrays."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        joined = "".join(marked)
        stops = np.cumsum([len(t) for t in marked], dtype=np.int64)
        kind = self.kind[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(joined) + 1, bool)
        cut[1:-1] = ~self.together[kind[:-1] * self.width + kind[1:]]
        cut[stops] = True
        edges = np.flatnonzero(cut)
        spots = edges.tolist()
        chunks = [joined[a:b] for a, b in zip(spots, spots[1:])]
        held = self.held
        parts = list(map(held.get, chunks))
        if None in parts:
            gaps = [i for i, p in enumerate(parts) if p is None]
            unseen = dict.fromkeys(chunks[i] for i in gaps)
            found = {c: self.older[c] for c in unseen if c in self.older}
            short = [c for c in unseen if c not in found and len(c) <= SHORT]
            found.update(zip(short, self.ids_together(short)))
            found.update((c, self.chunk_ids(c)) for c in unseen if c not in found)
            for i in gaps:
                parts[i] = found[chunks[i]]
            held.update((c, p) for c, p in found.items() if len(c) <= LONGEST)
        if len(self.held) > HELD:
            self.older, self.held = self.held, {}
        begin, end = np.array([self.begin], "<i4").tobytes(), np.array([self.end], "<i4").tobytes()
        bounds = np.searchsorted(edges, np.concatenate([[0], stops])).tolist()
        return [np.frombuffer(begin + b"".join(parts[a:b]) + end, "<i4") for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: list) -> str:
        surface = self.surface
        data = b"".join(map(surface.__getitem__, ids))
        if next((i for i in ids if surface[i]), None) in self.marked:
            data = data[1:]
        return data.decode("utf-8", "one_each")

    def decode_checked(self, ids: list) -> list:
        out = [self.decode(x) for x in ids]
        if out != self.library.decode(ids):
            raise ValueError("the pieces and the library decode ids differently")
        return out


_CODECS = {}


def codec(path: str) -> Codec:
    """The vocabulary and its table of chunks, kept by a Python worker from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def ids_digest(ids) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


#: What ``encode`` can return for a text: type, and value from its ids as an array and its decoded text.
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), lambda ids, text: ids),
    "n_tokens": (T.LongType(), lambda ids, text: len(ids)),
    "ids_sha256": (T.StringType(), lambda ids, text: ids_digest(ids)),
    "decoded": (T.StringType(), lambda ids, text: text),
}


def encode(docs: DataFrame, path: str, keep=None, outputs=("ids",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them if not given), then ``outputs`` for its ``text``. Ids
    are decoded again only where the decoded text is asked for."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")

    def batch(frames):
        own = codec(path)
        for f in batches_by_bytes(frames, "text", 1 << 20):
            texts = [t or "" for t in f["text"]]
            arrays = own.encode(texts)
            lists = [x.tolist() for x in arrays]
            if lists != own.library.encode(texts, num_threads=1, add_bos=True, add_eos=True):
                raise ValueError("the agenda and the library encode a text differently")
            decoded = own.decode_checked(lists) if "decoded" in outputs else repeat(None)
            made = list(zip(arrays, decoded))
            yield pd.DataFrame({"row": f["row"]} | {c: [OUTPUTS[c][1](*m) for m in made] for c in outputs})

    schema = T.StructType([kept.schema["row"], *[T.StructField(c, OUTPUTS[c][0]) for c in outputs]])
    return kept.mapInPandas(batch, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in names], *outputs)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of id arrays."""
    @F.pandas_udf(T.StringType())
    def texts(ids: pd.Series) -> pd.Series:
        own, out = codec(path), []
        for at in range(0, len(ids), 256):  # ids as Python numbers take much room
            out += own.decode_checked([x.tolist() for x in ids[at:at + 256]])
        return pd.Series(out, dtype=object)

    return texts(ids)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(read(spark, sf_dir, "documents"), default_path(), ["doc_id"], ("n_tokens", "ids_sha256", "decoded"))
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
