"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries are found without regular expressions. Every code point has a class; every class
(apostrophes by what follows them) is a function on four states, packed in one byte; functions compose
through a 256 x 256 table, so the state before every code point comes from a blocked prefix scan. A
boundary then depends on that state and the neighbouring classes. The slices between boundaries are
looked up in a cache of merged pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTER, NUMBER, OTHER, BLANK, SPACE, END, SHORT, LONG = range(8)
#: States: an apostrophe here starts a contraction; it does not (after a blank or other sign);
#: one more letter of a contraction to come; two more.
FREE, BLOCKED, ONE, TWO = range(4)
#: White space of the pattern's \s, fixed by Unicode (White_Space).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _pack(after: tuple[int, int, int, int]) -> int:
    return sum(s << (2 * k) for k, s in enumerate(after))


#: What each class makes of the states FREE, BLOCKED, ONE, TWO.
_STEP = np.zeros(8, np.uint8)
for _c, _after in {
    LETTER: (FREE, FREE, FREE, ONE), NUMBER: (FREE,) * 4, OTHER: (BLOCKED,) * 4, BLANK: (BLOCKED,) * 4,
    SPACE: (FREE,) * 4, END: (FREE,) * 4, SHORT: (ONE, BLOCKED, BLOCKED, BLOCKED), LONG: (TWO, BLOCKED, BLOCKED, BLOCKED),
}.items():
    _STEP[_c] = _pack(_after)


@functools.cache
def _compose() -> np.ndarray:
    """Entry f * 256 + g: the function that applies f, then g."""
    f, g = np.divmod(np.arange(1 << 16), 256)
    return sum((((g >> (2 * ((f >> (2 * k)) & 3))) & 3) << (2 * k)) for k in range(4)).astype(np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point; apostrophes are OTHER here."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE] = SPACE
    table[0x20] = BLANK
    return table


def scan(steps: np.ndarray, width: int = 64) -> np.ndarray:
    """State after each step, from FREE: an inclusive scan over function composition, in blocks.

    Composition is associative, so blocks are folded side by side, the block totals are scanned the same
    way, and each block then applies its prefix to the state it starts in.
    """
    n = len(steps)
    if n <= width:
        state, out = FREE, np.empty(n, np.uint8)
        for i, f in enumerate(steps.tolist()):
            state = (f >> (2 * state)) & 3
            out[i] = state
        return out
    table, rows = _compose(), -(-n // width)
    blocks = np.full(rows * width, _pack((FREE, BLOCKED, ONE, TWO)), np.uint8)
    blocks[:n] = steps
    blocks = np.ascontiguousarray(blocks.reshape(rows, width).T)
    for k in range(1, width):
        blocks[k] = table[(blocks[k - 1].astype(np.uint16) << 8) | blocks[k]]
    start = np.concatenate((np.array([FREE], np.uint8), scan(blocks[-1])[:-1]))
    return ((blocks >> (2 * start)[None, :]) & 3).T.reshape(-1)[:n]


def boundaries(points: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, over the code points of texts that each end in one END mark.

    points: code points, with anything at the marks; doc_ends: the positions of the marks.
    Returns a boolean array; marks count as starts.
    """
    c = _classes()[points]
    c[doc_ends] = END
    n = len(c)
    at = np.flatnonzero((points == 0x27) & (c != END))
    if len(at):
        p1 = np.where(c[np.minimum(at + 1, n - 1)] == END, 0, points[np.minimum(at + 1, n - 1)])
        p2 = np.where(c[np.minimum(at + 2, n - 1)] == END, 0, points[np.minimum(at + 2, n - 1)])
        r, v, e, ll = map(ord, "rvel")
        c[at[np.isin(p1, [ord(x) for x in "stmd"])]] = SHORT
        c[at[((p1 == r) & (p2 == e)) | ((p1 == v) & (p2 == e)) | ((p1 == ll) & (p2 == ll))]] = LONG
    after = scan(_STEP[c])
    plain = np.where((c == SHORT) | (c == LONG), OTHER, c).astype(np.uint8)
    opens = (after == ONE) & (c == SHORT) | (after == TWO)  # an apostrophe that starts a contraction
    prev, before, prev_after = np.empty_like(plain), np.empty_like(after), np.empty_like(after)
    prev[0], prev[1:] = END, plain[:-1]
    prev_after[0], prev_after[1:] = FREE, after[:-1]
    before[:] = prev_after
    inside = before >= ONE  # the letters of a contraction
    closed = np.zeros(n, bool)  # the contraction ended just before
    closed[2:] = (after[:-2] == ONE) & (after[1:-1] == FREE) & inside[1:-1]
    nxt = np.empty_like(plain)
    nxt[-1], nxt[:-1] = END, plain[1:]
    white, prev_white = (plain == BLANK) | (plain == SPACE), (prev == BLANK) | (prev == SPACE)
    next_solid = (nxt != BLANK) & (nxt != SPACE) & (nxt != END)
    start = np.where(white, ~prev_white | next_solid, (plain != prev) & (prev != BLANK))
    return (start | opens | closed | (plain == END) | (prev == END)) & ~inside


FAR = 1 << 60


class Vocabulary:
    """Ranks of a tiktoken file, which are also the ids, with a cache of merged pre-tokens, cleared when full."""

    def __init__(self, path: str, cache_entries: int = 200_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.widths = np.zeros(max(self.bytes) + 1, np.uint32)
        self.widths[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get = self.ranks.get
        pairs = {(x << 32) | y: i for t, i in self.ranks.items() for k in range(1, len(t))
                 if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[bytes, bytes] = {}
        self.limit = cache_entries

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, FAR if none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], FAR)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, merged side by side: each round joins, in every unfinished piece, the
        pair of least rank, the leftmost of equals. Very long pieces go through a heap."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for k, p in enumerate(pieces):
            if (i := self.ranks.get(p)) is not None:
                out[k] = i.to_bytes(4, "little")
            elif len(p) > 128:
                out[k] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                todo.append(k)
        if not todo:
            return out
        size = np.array([len(pieces[k]) for k in todo], np.int64)
        sym = self.single[np.frombuffer(b"".join([pieces[k] for k in todo]), np.uint8)]
        owner = np.repeat(np.array(todo, np.int64), size)
        rank = np.full(len(sym), FAR, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair(sym[inner], sym[inner + 1])
        done_sym, done_owner = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            count = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            if (least == FAR).any():
                rest = np.repeat(least == FAR, count)
                done_sym.append(sym[rest])
                done_owner.append(owner[rest])
                sym, owner, rank = sym[~rest], owner[~rest], rank[~rest]
                count, least = count[least < FAR], least[least < FAR]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            at = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
            sym[at] = least
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            # where the merged symbols stand once their right halves are gone
            at -= np.arange(len(at))
            sym, owner = sym[keep], owner[keep]
            keep[at + np.arange(len(at)) + 1] = True
            keep[at + np.arange(len(at))] = False
            rank = rank[keep]  # a merged symbol takes its right half's place; both of its pairs are looked up anew
            right = at[(at + 1 < len(sym))]
            right = right[owner[right + 1] == owner[right]]
            rank[at] = FAR
            rank[right] = self.pair(sym[right], sym[right + 1])
            left = at[at > 0]
            left = left[owner[left - 1] == owner[left]] - 1
            rank[left] = self.pair(sym[left], sym[left + 1])
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        packed, owner = sym[order].astype("<u4").tobytes(), owner[order]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for k, lo, hi in zip(owner[first].tolist(), (4 * first).tolist(), (4 * np.append(first[1:], len(owner))).tolist()):
            out[k] = packed[lo:hi]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length: a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (k := prev[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, end offsets in bytes) of each text, packed."""
        joined = "\0".join(texts) + "\0"
        raw = joined.encode("utf-8")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        starts = np.flatnonzero(boundaries(points, ends))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width)))
        cut = offset[starts].tolist()
        pieces = [raw[i:j] for i, j in zip(cut, cut[1:])]
        cache = self.cache
        missing = set(pieces).difference(cache)
        if len(cache) + len(missing) > self.limit:
            cache.clear()
            missing = set(pieces)
        missing = list(missing)
        cache.update(zip(missing, self.merge(missing)))
        out, lo = [], 0
        for hi in np.searchsorted(starts, ends).tolist():
            ids = b"".join([cache[p] for p in pieces[lo:hi]])
            out.append((ids, np.cumsum(self.widths[np.frombuffer(ids, "<u4")], dtype=np.uint32).astype("<u4").tobytes()))
            lo = hi + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def _groups(sizes: list[int], most: int):
    """Runs of texts of about `most` characters."""
    lo, total = 0, 0
    for hi, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, hi
            lo, total = hi, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _encoder(path: str):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [t or "" for t in batch.column(k).to_pylist()]
            for lo, hi in _groups([len(t) for t in texts], 1 << 20):
                got = v.encode(texts[lo:hi])
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns) if i != k]
                names = [n for i, n in enumerate(batch.schema.names) if i != k]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], [*names, "ids", "ends"])
    return run


def _decoder(path: str):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            ids = batch.column(k)
            for lo in range(0, len(ids), 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v.decode(x or b"") for x in part.column(k).to_pylist()], pa.binary())], [*batch.schema.names, "decoded"])
    return run


def _transcoder(path: str):
    encode, decode = _encoder(path), _decoder(path)
    return lambda batches: decode(encode(batches))


def _schema(fields, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + list(more))


def _texts(docs: DataFrame) -> DataFrame:
    common.bounded_batches(docs.sparkSession, rows=500, mb=8)
    return docs.select(*[c for c in docs.columns if c not in ("text", "ids", "ends", "decoded")], F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, plus ids and ends: packed little-endian unsigned 32-bit token ids and the byte
    offset at which each token ends. Null text is empty; an empty text has no tokens. Columns that clash
    with the new names are dropped; every other column and every repeated row stays."""
    d = _texts(docs)
    return d.mapInArrow(_encoder(path), _schema([f for f in d.schema.fields if f.name != "text"], "ids binary", "ends binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded: the bytes of the packed ids; null ids are empty. An unknown id is an error."""
    d = encoded.drop("decoded")
    return d.mapInArrow(_decoder(path), _schema(d.schema.fields, "decoded binary"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode, then decode of what it gave, in one pass over the texts."""
    d = _texts(docs)
    return d.mapInArrow(_transcoder(path), _schema([f for f in d.schema.fields if f.name != "text"], "ids binary", "ends binary", "decoded binary"))


def digests(transcoded: DataFrame) -> list:
    return [(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    d = round_trip(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path or vocabulary_path())
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), *digests(d))
