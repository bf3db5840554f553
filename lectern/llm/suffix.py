"""Suffix-array dedup: suffixes are ordered by most-significant-digit passes, through the threshold only.

A suffix is never ordered beyond `length` bytes, and one whose digit occurs once leaves the sort:

1. The first digit of a window of `length` bytes is its anchor: the leftmost `k` bytes of least hash among
   its `w` (k + w - 1 = length). Equal windows have equal anchors at equal offsets. A run of windows shares
   one anchor, so the pass sorts a few hundredths of the suffixes. Anchors that occur once leave.
2. The second digit of a run is all that its windows cover. Runs that agree in it repeat the first of them
   window by window; only the first goes on, and only where its anchor has other second digits.
3. The windows of the runs that are left are ordered by their whole `length` bytes (two 64-bit hashes).
   Equal groups are exactly the repeated windows; all but the first of each are removed.

Every task first sorts what it has read, and sends a digit on once, so one row of a digit reaches the
shuffle for each map task at most, however often a passage occurs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
#: Positions of one numpy pass at most, and about as many as one has; rows that a task sorts before it sends them on.
PIECE, BUFFER, UNIT = 1 << 20, 1 << 18, 2_000_000
_POS = np.uint64(PIECE - 1)
_U = np.uint64
#: What `at` holds: start << 10 | windows of the run << 2 | kind.
PLAIN, SURE, WITNESS, GONE = range(4)
NULL_ID = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


@functools.cache
def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of two hashes: a number for every byte, the powers of an odd base, and their inverses."""
    out = []
    for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        byte = mix(np.arange(1, 257, dtype=np.uint64) + _U(1000 * k))
        powers = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(PIECE + 1, b, np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p))
        out.append((byte, *powers))
    return out


def _sums(buf: np.ndarray, k: int) -> np.ndarray:
    byte, powers, _ = _tables()[k]
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte[buf] * powers[:len(buf)], out=s[1:])
    return s


def _slices(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    return (s[hi] - s[lo]) * _tables()[k][2][lo]


def shape(length: int) -> tuple[int, int]:
    """(w, k): anchors among which the least is chosen, a power of two, and their bytes."""
    w = 1 << max(0, (2 * length // 3).bit_length() - 1)
    return w, length - w + 1


def runs(buf: np.ndarray, first: np.ndarray, size: np.ndarray, length: int):
    """Runs of windows that share an anchor: (start, windows, first digit, second digit) over the pieces
    of buf that begin at `first` and have `size` bytes each, `length` at least."""
    w, k = shape(length)
    s0, s1 = _sums(buf, 0), _sums(buf, 1)
    n = len(buf) - length + 1
    grams = mix((s0[k:] - s0[:-k]) * _tables()[0][2][:len(buf) - k + 1])
    low = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    edge = np.zeros(n + 1, np.int8)
    edge[first] += 1
    np.subtract.at(edge, first + size - length + 1, 1)
    valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    same = np.zeros(n + 1, bool)
    same[1:n] = valid[1:] & valid[:-1] & (low[1:] == low[:-1])
    lo = np.flatnonzero(valid & ~same[:n])
    hi = np.flatnonzero(valid & ~same[1:])
    at = (low[lo] & _POS).astype(np.int64)
    count = hi - lo + 1
    whole = _slices(s1, lo, hi + length, 1) + _U(0x2545F4914F6CDD1D) * (at - lo).astype(np.uint64) + _U(0x9E6C63D0876A9A35) * count.astype(np.uint64)
    return lo, count, grams[at], mix(whole)


def _pieces(batches, length: int):
    """(d, t, bytes, offset in the text) of texts of at least `length` bytes, long ones cut with overlap."""
    for b in batches:
        for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = text.as_buffer()
            n = 0 if data is None else data.size
            if n >= length:
                for lo in range(0, max(1, n - length + 1), PIECE - length + 1):
                    yield d, t, np.frombuffer(data, np.uint8, min(PIECE, n - lo), lo), lo


def _buffers(batches, length: int):
    """Pieces side by side: (buf, first, size, d, t, offset)."""
    held, total = [], 0

    def flush():
        size = np.array([len(p[2]) for p in held], np.int64)
        return (np.concatenate([p[2] for p in held]), np.cumsum(size) - size, size, np.array([p[0] for p in held], np.int64),
                np.array([p[1] for p in held], np.int64), np.array([p[3] for p in held], np.int64))

    for p in _pieces(batches, length):
        if held and (total >= BUFFER or total + len(p[2]) > PIECE):
            yield flush()
            held, total = [], 0
        held.append(p)
        total += len(p[2])
    if held:
        yield flush()


def _merged(d: np.ndarray, t: np.ndarray, at: np.ndarray):
    """Removed runs (d, t, at) as (d, t, start, windows), runs that follow each other joined."""
    order = np.lexsort((at, t, d))
    d, t, start, n = d[order], t[order], at[order] >> 10, (at[order] >> 2) & 255
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (start[1:] > start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], t[first], start[first], start[last] + n[last] - start[first]


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["key", "f", "d", "t", "at"])


def _combined(key: np.ndarray, f: np.ndarray, d: np.ndarray, t: np.ndarray, at: np.ndarray, last: bool):
    """What one task sends on. Of equal (key, f) only the first; the others are gone already.

    last: the windows' own pass, where nothing but the first of each (key, f) matters. Before it, a key with
    several f here is known to be repeated: its rows go by f, and one of them by key, as a witness.
    """
    order = np.argsort(key)
    k = key[order]
    again = np.zeros(len(k) + 1, bool)
    again[1:-1] = k[1:] == k[:-1]
    lone = order[~(again[1:] | again[:-1])]
    yield key[lone], f[lone], d[lone], t[lone], at[lone]
    dup = order[again[1:] | again[:-1]]
    if not len(dup):
        return
    dup = dup[np.lexsort((at[dup], t[dup], d[dup], f[dup], key[dup]))]
    k, v, e, o, a = key[dup], f[dup], d[dup], t[dup], at[dup]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= v[1:] != v[:-1]
    rep = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    gone = (e != e[rep]) | (o != o[rep]) | (a != a[rep])
    if gone.any():
        x, y, start, n = _merged(e[gone], o[gone], a[gone])
        yield mix(x.view(np.uint64) + y.view(np.uint64) + start.view(np.uint64)), n.view(np.uint64), x, y, (start << 10) | GONE
    heads = np.flatnonzero(new_key)
    several = np.repeat(np.add.reduceat(new, heads, dtype=np.int64) > 1, np.diff(np.append(heads, len(k))))
    if last:
        several[:] = False
    one = new & ~several
    yield k[one], v[one], e[one], o[one], a[one]
    many = new & several
    yield mix(v[many]), v[many], e[many], o[many], a[many] | SURE
    seen = new_key & several
    yield k[seen], v[seen], e[seen], o[seen], a[seen] | WITNESS


def _send(found, last: bool):
    """found: arrays (key, f, d, t, at). Sorts units of rows and sends on what is left of each."""
    held, total = [], 0

    def flush():
        for part in _combined(*(np.concatenate(x) for x in zip(*held)), last):
            for lo in range(0, len(part[0]), 200_000):
                yield _rows(*(x[lo:lo + 200_000] for x in part))

    for part in found:
        held.append(part)
        total += len(part[0])
        if total >= UNIT:
            yield from flush()
            held, total = [], 0
    if held:
        yield from flush()


def _find_runs(length: int):
    def found(batches):
        for buf, first, size, d, t, offset in _buffers(batches, length):
            lo, count, g, f = runs(buf, first, size, length)
            p = np.searchsorted(first, lo, "right") - 1
            yield g, f, d[p], t[p], ((lo - first[p] + offset[p]) << 10) | (count << 2)

    return lambda batches: _send(found(batches), False)


def _find_windows(length: int):
    """Whole keys of the windows of the runs that the rows hold besides the text."""
    def found(batches):
        for b in batches:
            starts, counts = b.column(3), b.column(4)
            for i, (d, t, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                lo, n = (np.asarray(c[i].values) for c in (starts, counts))
                s = np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
                while len(s):  # in pieces
                    part = s[:np.searchsorted(s, s[0] + PIECE - length + 1)]
                    buf, at = data[part[0]:part[-1] + length], part - part[0]
                    keys = [mix(_slices(_sums(buf, k), at, at + length, k)) for k in (0, 1)]
                    yield *keys, np.full(len(part), d, np.int64), np.full(len(part), t, np.int64), (part << 10) | 4
                    s = s[len(part):]

    return lambda batches: _send(found(batches), True)


def _settle(last: bool):
    """Over rows sorted by key, f and place: (d, t, start, windows, open); open runs go on, others are removed."""
    def out(d, t, at, n, is_open):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(at >> 10), pa.array(n), pa.array(np.full(len(d), is_open))], ["d", "t", "start", "n", "open"])

    def judged(key, f, d, t, at):
        kind = at & 3
        through = kind == GONE
        yield out(d[through], t[through], at[through], f[through], False)
        key, f, d, t, at, kind = (x[~through] for x in (key, f, d, t, at, kind))
        if not len(key):
            return
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= f[1:] != f[:-1]
        rep = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        gone = (d != d[rep]) | (t != t[rep]) | (at >> 2 != at[rep] >> 2)
        yield out(d[gone], t[gone], at[gone], (at[gone] >> 2) & 255, False)
        if not last:
            heads = np.flatnonzero(new_key)
            known = (np.add.reduceat(new, heads, dtype=np.int64) > 1) | (np.maximum.reduceat(kind, heads) > 0)
            left = new & np.repeat(known, np.diff(np.append(heads, len(key)))) & (kind != WITNESS)
            yield out(d[left], t[left], at[left], (at[left] >> 2) & 255, True)

    def run(batches):
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if carry is not None:
                part = [np.concatenate(x) for x in zip(carry, part)]
            cut = int(np.searchsorted(part[0], part[0][-1]))  # keys ascend: the last one may go on
            carry = [x[cut:] for x in part]
            if cut:
                yield from judged(*(x[:cut] for x in part))
        if carry is not None:
            yield from judged(*carry)

    return run


_SENT = "key long, f long, d long, t long, at long"
_SETTLED = "d long, t long, start long, n long, open boolean"
_PLACE = ["key", "f", "d", "t", "at"]


def ids_repeat(docs: DataFrame) -> bool:
    """Whether two rows share an id, or lack one."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()


def keys(repeats: bool) -> list:
    """d orders documents, null ids last; t, a 64-bit hash of the text, orders texts that share an id and is equal for rows that
    repeat both (0 where no two rows share an id); data is the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), (F.xxhash64(text) if repeats else F.lit(0).cast("long")).alias("t"), text.cast("binary").alias("data")]


def repeated(k: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of the texts (d, t, data), (d, t, start, n): every window of `length` bytes from start to start + n - 1 that also starts
    earlier (smaller doc_id, or the same document, earlier). Intervals may overlap or repeat.

    Texts shorter than `length` have none. Different texts of one d are ordered by t; rows that repeat both are one document.
    """
    sent = k.where(F.octet_length("data") >= length).mapInArrow(_find_runs(length), _SENT)
    settled = sent.repartition("key").sortWithinPartitions(*_PLACE).mapInArrow(_settle(False), _SETTLED)
    settled = common.materialize(settled, "runs", rows=50_000)  # the MB bound texts
    left = settled.where("open").groupBy("d", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))  # of one document
    joined = k.join(left.hint("shuffle_hash"), ["d", "t"]).select("d", "t", "data", "starts", "ns")
    windows = joined.mapInArrow(_find_windows(length), _SENT).repartition("key").sortWithinPartitions(*_PLACE)
    exact = common.materialize(windows.mapInArrow(_settle(True), _SETTLED), "windows", rows=1000)
    return settled.where("not open").unionByName(exact).select("d", "t", "start", "n")


def removed_bytes(n: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Removed spans of a text of n bytes, as (first, end) rows, in order and apart."""
    order = np.argsort(starts, kind="stable")
    lo = starts[order]
    hi = np.minimum(np.maximum.accumulate(lo + counts[order] + length - 1), n)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return np.stack((lo[first], hi[np.append(first[1:], len(lo)) - 1]), 1) if len(lo) else np.zeros((0, 2), np.int64)


def _cutter(length: int, characters: bool):
    def run(batches):
        for b in batches:
            names = b.schema.names
            at = {x: names.index(x) for x in ("_data", "_starts", "_ns")}
            kept, removed, count = [], [], []
            for data, lo, n in zip(b.column(at["_data"]), b.column(at["_starts"]), b.column(at["_ns"])):
                raw = data.as_py() or b""
                if not lo.is_valid or not len(lo.values):
                    spans = []
                else:
                    spans = removed_bytes(len(raw), np.asarray(lo.values), np.asarray(n.values), length).tolist()
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept.append(b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2])]) if spans else raw)
                removed.append(len(raw) - len(kept[-1]))
                if characters and spans:
                    kept[-1] = kept[-1].decode("utf-8", "ignore").encode()
                count.append(len(spans))
            rest = [(x, c) for x, c in zip(names, b.columns) if x not in at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                                             [*[x for x, _ in rest], "kept", "n_removed", "n_spans"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, characters: bool = False) -> DataFrame:
    """docs without text, plus kept (the bytes that stay, joined), n_removed and n_spans (removed runs).

    Each byte goes that a string of `length` bytes covers which also starts earlier in the corpus; overlaps
    count, and strings are judged on the input. characters: what is left of a cut character goes too. Null texts are empty; every row stays, repeated ones alike;
    columns that clash with the new names are dropped; an empty table gives no rows.
    """
    new = ("kept", "n_removed", "n_spans", "_d", "_t", "_data", "_starts", "_ns")
    own = keys(ids_repeat(docs))
    gone = repeated(docs.select(*own), length).groupBy("d", "t").agg(F.collect_list("start").alias("_starts"), F.collect_list("n").alias("_ns"))  # of one document
    gone = gone.withColumnsRenamed({"d": "_d", "t": "_t"})
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*new, "text")], *[c.alias(f"_{x}") for c, x in zip(own, ("d", "t", "data"))])
    common.bounded_batches(docs.sparkSession)
    j = d.join(gone.hint("shuffle_hash"), ["_d", "_t"], "left").drop("_d", "_t")
    fields = [f for f in j.schema.fields if f.name not in ("_data", "_starts", "_ns")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["kept binary", "n_removed long", "n_spans long"])
    return j.mapInArrow(_cutter(length, characters), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"),
                    "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
