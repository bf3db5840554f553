"""Interpolated modified Kneser-Ney language model of order two, counted in Spark, memory-mapped by workers.

Counting: every task counts the word pairs of what it reads and deals them out by the pair's hash, packed, one
row for each task and share. A share counts its pairs over all tasks, writes them to the shared folder as a
sorted array of hashes with counts, and deals out what it saw of each word (kinds of successors by their
count, distinct predecessors). A second deal by the word's hash adds these up and writes sorted word arrays.
Scoring maps the arrays and looks up the distinct words and pairs of each batch.

Words are hashes of 64 bits in the word arrays and in pair hashes; between tasks pairs travel as two 48-bit
ends of them.
"""

from __future__ import annotations

import functools
import math
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens that a task counts at once; text bytes for each share of the pairs; texts of one tokenizer pass.
UNIT, SHARE_BYTES, CHUNK = 4_000_000, 48 << 20, 1 << 20
_U = np.uint64
_CUT = _U((1 << 48) - 1)
#: The end of a text as a token, and what stands before its first.
END, START = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


@functools.cache
def _tables():
    """Lower-casing of A-Z, white space, a number for each byte, and the powers of an odd base."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    white = np.zeros(256, bool)
    white[[0x20, *range(9, 14)]] = True
    powers = np.full(1 << 16, 0xD6E8FEB86659FD93, np.uint64)
    powers[0] = 1
    return lower, white, mix(np.arange(1, 257, dtype=np.uint64)), np.cumprod(powers)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, each text closed by END, and how many tokens each text has."""
    lower, white, number, powers = _tables()
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    hashes, starts, lo = [], [], 0
    while lo < len(raw):
        hi = min(lo + CHUNK, len(raw))
        while hi < len(raw) and not white[raw[hi - 1]]:  # words stay whole: cut after white space
            back = np.flatnonzero(white[raw[max(lo, hi - 4096):hi]])
            hi = max(lo, hi - 4096) + back[-1] + 1 if len(back) else min(hi + CHUNK, len(raw))
        part = raw[lo:hi]
        solid = ~white[part]
        first = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
        if len(first):
            last = np.flatnonzero(solid & np.concatenate((~solid[1:], [True])))
            at = np.flatnonzero(solid)
            width = last - first + 1
            begin = np.cumsum(width) - width
            place = np.arange(len(at)) - np.repeat(begin, width)
            h = np.add.reduceat(number[lower[part[at]]] * powers[place & 0xFFFF], begin)
            hashes.append(mix(h + _U(0x2545F4914F6CDD1D) * width.astype(np.uint64)))
            starts.append(first + lo)
        lo = hi
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    of = np.searchsorted(ends, np.concatenate(starts) if starts else np.zeros(0, np.int64))
    count = np.bincount(of, minlength=len(texts)).astype(np.int64) + 1
    out = np.empty(count.sum(), np.uint64)
    stop = np.cumsum(count) - 1
    inner = np.ones(len(out), bool)
    inner[stop] = False
    out[inner], out[stop] = words, END
    return out, count


def before(toks: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The token before each, START before a text's first."""
    prev = np.empty_like(toks)
    prev[1:] = toks[:-1]
    prev[np.cumsum(count) - count] = START
    return prev


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's hash: of 48 bits of either word, which is what travels."""
    return mix((u & _CUT) * _U(0xA0761D6478BD642F) + mix(w & _CUT))


def _short(x: np.ndarray) -> np.ndarray:
    """The low 48 bits as bytes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _long(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _counts(n: np.ndarray) -> bytes:
    """One byte each; 255 and more follow as 8 bytes."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def _uncounted(raw: np.ndarray, n: int) -> np.ndarray:
    out = raw[:n].astype(np.int64)
    out[out == 255] = raw[n:].view("<u8") if raw[n:].flags.aligned else np.frombuffer(raw[n:].tobytes(), "<u8")
    return out


def _share(h: np.ndarray, shares: int) -> np.ndarray:
    """Which of 2**k shares: the top bits."""
    bits = shares.bit_length() - 1
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


_BLOBS = pa.schema([("share", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def _pack_words(h: np.ndarray, columns: list[np.ndarray], short: bool = False) -> bytes:
    return (_short(h) if short else h.astype("<u8")).tobytes() + b"".join(len(c := _counts(x)).to_bytes(8, "little") + c for x in columns)


def _unpack_words(data: bytes, n: int, short: bool = False) -> list[np.ndarray]:
    at, out = (6 if short else 8) * n, []
    h = _long(np.frombuffer(data, np.uint8, at)) if short else np.frombuffer(data, "<u8", n)
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(_uncounted(np.frombuffer(data, np.uint8, size, at + 8), n))
        at += 8 + size
    return [h, *out]


def _counter(shares: int):
    """Rows (share, kind, n, data) of a task's units: kind 0 pairs (two 48-bit words, count), kind 1 words (hash, count)."""
    def flush(held):
        toks = np.concatenate([h[0] for h in held])
        count = np.concatenate([h[1] for h in held])
        held.clear()
        words, own = np.unique(toks, return_inverse=True)
        used = np.bincount(own)
        v = len(words) + 1  # the last number is START's
        prev = np.empty_like(own)
        prev[1:] = own[:-1]
        prev[np.cumsum(count) - count] = v - 1
        code = np.sort(prev * v + own)
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n = np.diff(np.append(first, len(code)))
        u, w = np.divmod(code[first], v)
        every = np.append(words, START)
        u, w = every[u], every[w]
        g = pair(u, w)
        rows = []
        for kind, key, data in ((0, g, lambda x: _short(u[x]).tobytes() + _short(w[x]).tobytes() + _counts(n[x])),
                                (1, every << _U(16), lambda x: _pack_words(every[x], [np.append(used, len(count))[x]]))):
            s = _share(key, shares)
            order = np.argsort(s, kind="stable")
            edge = np.searchsorted(s[order], np.arange(shares + 1))
            for k in range(shares):
                x = order[edge[k]:edge[k + 1]]
                if len(x):
                    rows.append({"share": k, "kind": kind, "n": len(x), "data": data(x)})
        for r in rows:
            yield pa.RecordBatch.from_pylist([r], _BLOBS)

    def run(batches):
        held, total = [], 0
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            if texts:
                held.append(tokens(texts))
                total += len(held[-1][0])
            if total >= UNIT:
                yield from flush(held)
                total = 0
        if held:
            yield from flush(held)
    return run


def _create(folder: str, name: str, *arrays: np.ndarray) -> str:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).view(np.uint8).data)
    return f"{folder}/{name}"


def _by_share(batches):
    """(share, rows) of batches that are sorted by share."""
    now, held = None, []
    for b in batches:
        for s, kind, n, data in zip(*(b.column(i).to_pylist() for i in range(4))):
            if s != now and held:
                yield now, held
                held = []
            now = s
            held.append((kind, n, data))
    if held:
        yield now, held


def _sum_words(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return [h[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in range(1, len(parts[0])))]


def _pair_share(folder: str, shares: int):
    """Counts a share's pairs, writes them, and sends on words: kind 1 as they came, kind 2 (48-bit word, then
    its successors seen once, twice, more often, and its predecessors). Kind 3 names the file."""
    def run(batches):
        for s, held in _by_share(batches):
            u, w, c, words = [], [], [], []
            for kind, n, data in held:
                if kind == 1:
                    words.append(_unpack_words(data, n))
                    continue
                raw = np.frombuffer(data, np.uint8)
                u.append(_long(raw[:6 * n]))
                w.append(_long(raw[6 * n:12 * n]))
                c.append(_uncounted(raw[12 * n:], n))
            held.clear()
            if words:
                h, used = _sum_words(words)
                del words
                yield pa.RecordBatch.from_pylist([{"share": s, "kind": 1, "n": len(h), "data": _pack_words(h, [used])}], _BLOBS)
            if not u:
                continue
            u, w, c = np.concatenate(u), np.concatenate(w), np.concatenate(c)
            g = pair(u, w)
            order = np.argsort(g)
            g = g[order]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            c = np.add.reduceat(c[order], first)
            u, w, g = u[order[first]], w[order[first]], g[first]
            big = c >= 255
            name = _create(folder, f"pairs-{uuid.uuid4().hex}", g, g[big], c[big].astype(np.uint64), np.minimum(c, 255).astype(np.uint8))
            once = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            meta = np.array([len(g), int(big.sum()), *once], "<i8").tobytes() + name.encode()
            yield pa.RecordBatch.from_pylist([{"share": s, "kind": 3, "n": len(g), "data": meta}], _BLOBS)
            zero = np.zeros(len(c), np.int64)
            one, two = (c == 1).astype(np.int64), (c == 2).astype(np.int64)
            h, n1, n2, n3, p = _sum_words([[u, one, two, 1 - one - two, zero], [w, zero, zero, zero, zero + 1]])
            # shares of words go by the low 48 bits, which is what is known of a pair's words
            t = _share(h << _U(16), shares)
            order = np.argsort(t, kind="stable")
            edge = np.searchsorted(t[order], np.arange(shares + 1))
            for k in range(shares):
                x = order[edge[k]:edge[k + 1]]
                if len(x):
                    yield pa.RecordBatch.from_pylist([{"share": k, "kind": 2, "n": len(x), "data": _pack_words(h[x], [n1[x], n2[x], n3[x], p[x]], True)}], _BLOBS)
    return run


def _word_share(folder: str, discounts: tuple[float, float, float]):
    """Adds up a share's words, writes (hash, mass that discounts free, count, predecessors), and names the file.
    Two words that share 48 bits share what pairs tell of them."""
    def run(batches):
        for s, held in _by_share(batches):
            used = _sum_words([_unpack_words(d, n) for kind, n, d in held if kind == 1])
            seen = _sum_words([_unpack_words(d, n, True) for kind, n, d in held if kind == 2])
            held.clear()
            at = np.searchsorted(seen[0], used[0] & _CUT)
            n1, n2, n3, p = (x[at] for x in seen[1:])
            free = discounts[0] * n1 + discounts[1] * n2 + discounts[2] * n3
            order = np.argsort(used[0])
            h, c, free, p = used[0][order], used[1][order], free[order], p[order]
            name = _create(folder, f"words-{uuid.uuid4().hex}", h, free.astype(np.float64), c.astype(np.uint64), p.astype(np.uint64))
            real = h != START
            once = [int((p[real] == k).sum()) for k in (1, 2, 3, 4)]
            meta = np.array([len(h), int(c[real].sum()), int(real.sum()), int((p[real] >= 3).sum()), *once], "<i8").tobytes() + name.encode()
            yield pa.RecordBatch.from_pylist([{"share": s, "kind": 4, "n": len(h), "data": meta}], _BLOBS)
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts of one, two and more (Chen and Goodman), kept between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.1 * (k + 1)), k + 0.95) for k, x in enumerate(d))


def _spans(share: np.ndarray) -> list[tuple[int, int, int]]:
    """(share, first, end) of the runs of a sorted array."""
    edge = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(share)]
    return [(int(share[lo]), lo, hi) for lo, hi in zip(edge, edge[1:]) if lo < hi]


class Files:
    """A fitted model: the names of its arrays and the figures that hold for all of them."""

    def __init__(self, shares, pairs, words, n, v, d2, d1, free1, kinds):
        self.shares, self.pairs, self.words, self.n, self.v, self.d2, self.d1, self.free1, self.kinds = shares, pairs, words, n, v, d2, d1, free1, kinds


_WIRE = "share int, kind int, n long, data binary"


def fit(docs: DataFrame, text: str = "text") -> Files:
    """Counts all of docs and writes the arrays. Only a row for each share reaches the driver: file names and totals."""
    spark = docs.sparkSession
    data = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    size = data.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    shares = 1 << max(0, math.ceil(math.log2(max(1, size / SHARE_BYTES))))
    folder = common.scratch(spark, "lm")
    sent = data.mapInArrow(_counter(shares), _WIRE)
    return _fit(spark, sent, shares, folder)


def _fit(spark: SparkSession, sent: DataFrame, shares: int, folder: str) -> Files:
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(shares, F.col("share")).sortWithinPartitions("share")

    first = common.materialize(dealt(sent).mapInArrow(_pair_share(folder, shares), _WIRE), "pairs", rows=1000, mb=8)
    pairs = [(r["share"], *_meta(r["data"], 6)) for r in first.where("kind = 3").select("share", "data").collect()]
    d2 = discounts(*(sum(p[1][k] for p in pairs) for k in (2, 3, 4, 5)))
    second = common.materialize(dealt(first.where("kind in (1, 2)")).mapInArrow(_word_share(folder, d2), _WIRE), "words", rows=1000, mb=8)
    words = [(r["share"], *_meta(r["data"], 8)) for r in second.select("share", "data").collect()]
    n, v, more, *once = (sum(w[1][k] for w in words) for k in range(1, 8))
    d1 = discounts(*once)
    kinds = sum(p[1][0] for p in pairs)
    free1 = d1[0] * once[0] + d1[1] * once[1] + d1[2] * more
    return Files(shares, {s: (m[0], m[1], name) for s, m, name in pairs}, {s: (m[0], name) for s, m, name in words}, n, v, d2, d1, free1, kinds)


def _meta(data: bytes, n: int) -> tuple[list[int], str]:
    return np.frombuffer(data, "<i8", n).tolist(), bytes(data[8 * n:]).decode()


def _mounted(uri: str) -> bool:
    return urlsplit(uri).scheme in ("", "file")


def _mapped(uri: str):
    """A file's bytes: memory-mapped where the shared folder is mounted, else read."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if _mounted(uri):
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


class Arrays:
    """Lookups in the sorted arrays of a model. Maps are kept; where files are read instead, it is one share at a time."""

    def __init__(self, files: Files):
        self.files, self.maps = files, {}

    def _file(self, name: str) -> np.ndarray:
        if not _mounted(name):
            return _mapped(name)
        if name not in self.maps:
            self.maps[name] = _mapped(name)
        return self.maps[name]

    def _pairs(self, s: int) -> tuple[np.ndarray, ...]:
        n, big, name = self.files.pairs[s]
        m, e = self._file(name), [0, 8 * n, 8 * (n + big), 8 * (n + 2 * big), 8 * (n + 2 * big) + n]
        return m[e[0]:e[1]].view("<u8"), m[e[1]:e[2]].view("<u8"), m[e[2]:e[3]].view("<u8"), m[e[3]:e[4]]

    def _words(self, s: int) -> tuple[np.ndarray, ...]:
        n, name = self.files.words[s]
        m = self._file(name)
        return m[:8 * n].view("<u8"), m[8 * n:16 * n].view("<f8"), m[16 * n:24 * n].view("<u8"), m[24 * n:32 * n].view("<u8")

    @staticmethod
    def _find(sorted_keys, keys):
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def word(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Freed mass, count and predecessors of distinct words; zero if never seen."""
        free, c, p = np.zeros(len(h)), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        share = _share(h << _U(16), self.files.shares)
        order = np.argsort(share, kind="stable")
        for s, lo, hi in _spans(share[order]):
            if s in self.files.words:
                keys, f, n, q = self._words(s)
                own = order[lo:hi]
                at, ok = self._find(keys, h[own])
                own, at = own[ok], at[ok]
                free[own], c[own], p[own] = f[at], n[at], q[at]
        return free, c, p

    def pair(self, g: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted pair hashes."""
        out = np.zeros(len(g), np.int64)
        for s, lo, hi in _spans(_share(g, self.files.shares)):
            if s in self.files.pairs:
                keys, big, more, c = self._pairs(s)
                at, ok = self._find(keys, g[lo:hi])
                n = np.where(ok, c[at], 0).astype(np.int64)
                large = np.flatnonzero(n == 255)
                if len(large):
                    n[large] = more[self._find(big, g[lo:hi][large])[0]]
                out[lo:hi] = n
        return out

    def unigram(self, p: np.ndarray) -> np.ndarray:
        """Kneser-Ney probability by distinct predecessors, interpolated with the uniform over V + 1."""
        m = self.files
        if not m.kinds:
            return np.full(len(p), 1 / (m.v + 1))
        return (np.maximum(p - _discount(p, m.d1), 0) + m.free1 / (m.v + 1)) / m.kinds

    def score(self, toks: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each text: known tokens, base score, model score (log10)."""
        m = self.files
        words, own = np.unique(toks, return_inverse=True)
        every = np.append(words, START)
        free, c, p = self.word(every)
        p1 = self.unigram(p)
        prev = np.empty_like(own)
        prev[1:] = own[:-1]
        first = np.cumsum(count) - count
        prev[first] = len(words)
        v = len(every)
        kinds, of = np.unique(prev * v + own, return_inverse=True)
        u, w = np.divmod(kinds, v)
        g = pair(every[u], every[w])
        order = np.argsort(g)
        n = np.empty(len(g), np.int64)
        n[order] = self.pair(g[order])
        total = c[u]
        with np.errstate(divide="ignore", invalid="ignore"):
            prob = np.where(total > 0, (np.maximum(n - _discount(n, m.d2), 0) + free[u] * p1[w]) / total, p1[w])
        base = np.log10((c[:-1] + 1) / (m.n + m.v + 1))
        return np.add.reduceat((c[:-1] > 0).astype(np.int64)[own], first), np.add.reduceat(base[own], first), np.add.reduceat(np.log10(prob)[of], first)


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _scorer(files: Files):
    def run(batches):
        model = Arrays(files)
        for b in batches:
            k = b.schema.get_field_index("_data")
            if not b.num_rows:
                continue
            toks, count = tokens([t or b"" for t in b.column(k).to_pylist()])
            known, base, score = model.score(toks, count)
            rest = [(n, c) for i, (n, c) in enumerate(zip(b.schema.names, b.columns)) if i != k]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(count), pa.array(known), pa.array(base), pa.array(score), pa.array(10 ** (-score / count))],
                                             [*[n for n, _ in rest], "n_tokens", "n_known", "base_score", "score", "perplexity"])
    return run


def score(docs: DataFrame, files: Files) -> DataFrame:
    """docs without text, plus n_tokens (an end for each text included), n_known, base_score and score (log10 of
    add-one unigrams and of the model), perplexity.

    Null and empty texts have one token, the end. Without training texts every token has probability one.
    Repeated rows are scored alike; columns that clash with the new names are dropped.
    """
    common.bounded_batches(docs.sparkSession, mb=8)
    new = ("n_tokens", "n_known", "base_score", "score", "perplexity", "_data")
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new and c != "text"], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_data"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "_data")
    return d.mapInArrow(_scorer(files), f"{fields}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    files = fit(d.where(~F.col("held_out")))
    s = score(d, files).withColumn("train_tokens", F.lit(files.n).cast("long"))
    return s.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
