"""Substring dedup over words by relative Lempel-Ziv parsing.

The reference is the corpus itself, of which each passage's first occurrence is kept: a seed of `k` words, chosen by least
hash among the `w` of every window (w + k - 1 = window), is indexed by its first document. Index blocks are the hash ranges
of a shuffle; each document is parsed against all of them, seed by seed:

1. Seeds. The windows of a document that choose one seed are a run. A run whose seed occurs in no other document leaves.
2. Parsing. A run meets the reference of its seed. A run of the same words is a factor at once. For others the words around
   both seeds are laid side by side; the longest stretch of equal words is the factor, and from `window` words on it is
   a duplicate span.
3. Boundaries. Windows that reach over the ends of a factor may stand in a later reference. They are told apart
   by all their words, and those go which an earlier document has at one of its own boundaries.

A window that two documents share is a run's in both, with one seed. So either both lie in factors of the reference, or neither does,
and steps 2 and 3 find every one. Words are compared by 64-bit hashes, windows at boundaries by two.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffix import ids_repeat, keys, mix

WINDOW = 50
#: Words of one numpy pass at most (longer texts are parsed in overlapping pieces), and about as many as one has.
PIECE, BUFFER = 1 << 18, 1 << 17
#: Words whose hashes a task keeps.
ROOM = 500_000
_U = np.uint64
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(PIECE + 1, b, _U)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


class Hashes(dict):
    """64-bit hashes of words, each taken once while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= ROOM:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sums(h: np.ndarray, base: int) -> np.ndarray:
    s = np.zeros(len(h) + 1, _U)
    np.cumsum(h * _powers(base)[0][:len(h)], out=s[1:])
    return s


def spans(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """One hash for the words from lo to hi - 1, wherever they stand."""
    return (s[hi] - s[lo]) * _powers(base)[1][lo]


def shape(window: int) -> tuple[int, int]:
    """(w, k): seeds among which the least is chosen, a power of two, and their words."""
    w = 1 << max(0, (2 * window // 3).bit_length() - 1)
    return w, window - w + 1


def runs(h: np.ndarray, window: int):
    """Windows of a text that share a seed: (first window, windows, seed's place, seed, hash of all words of the run)."""
    w, k = shape(window)
    s = sums(h, _BASES[0])
    at = np.arange(len(h) - k + 1)
    seeds = mix(spans(s, at, at + k, _BASES[0]))
    low = (seeds & ~_U(PIECE - 1)) | at.astype(_U)
    step = 1
    while step < w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    lo = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    n = np.diff(np.append(lo, len(low)))
    place = (low[lo] & _U(PIECE - 1)).astype(np.int64)
    s = sums(h, _BASES[1])
    whole = spans(s, lo, lo + n + window - 1, _BASES[1]) + (place - lo).astype(_U) * _U(0x9E6C63D0876A9A35) + n.astype(_U)
    return lo, n, place, seeds[place], mix(whole)


def words_of(data: pa.Buffer | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at just these."""
    return data.to_pybytes().split() if data is not None else []


def _find_runs(window: int):
    """(seed, f, d, t, lo, n, place) of (d, t, data)."""
    def run(batches):
        held, known = [], Hashes()
        for b in batches:
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = known.of(words_of(text.as_buffer()))
                for first in range(0, len(h) - window + 1, PIECE - window + 1):
                    lo, n, place, seed, f = runs(h[first:first + PIECE], window)
                    held.append((seed.view(np.int64), f.view(np.int64), np.full(len(lo), d), np.full(len(lo), t), lo + first, n, place + first))
            if sum(len(x[0]) for x in held) > BUFFER:
                yield _runs_batch(held)
                held = []
        if held:
            yield _runs_batch(held)

    return run


def _runs_batch(held) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["seed", "f", "d", "t", "lo", "n", "place"])


def _cut_out(window: int):
    """The words, as hashes, that each run of a text covers."""
    def run(batches):
        known = Hashes()
        for b in batches:
            out = []
            for i, (d, t, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                h = known.of(words_of(text.as_buffer())).view(np.int64)
                for x in b.column(3)[i].as_py():
                    out.append((x["seed"], d, t, x["lo"], x["n"], x["place"], x["role"], h[x["lo"]:x["lo"] + x["n"] + window - 1]))
                    if len(out) == 20_000:
                        yield _cut_batch(out)
                        out = []
            if out:
                yield _cut_batch(out)

    return run


_CUT = "seed long, d long, t long, lo long, n long, place long, role int, words array<long>"


def _cut_batch(out) -> pa.RecordBatch:
    cols = list(zip(*out))
    sizes = np.array([len(x) for x in cols[7]])
    words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(cols[7])))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.int32()), words], ["seed", "d", "t", "lo", "n", "place", "role", "words"])


def longest_factor(own: np.ndarray, at: int, other: np.ndarray, other_at: int, k: int) -> tuple[int, int]:
    """The stretch of own words, first and end, that equals other's around one seed of k words at own[at] and other[other_at]."""
    left = min(at, other_at)
    differ = np.flatnonzero(own[at - left:at] != other[other_at - left:other_at])
    first = at - left + (differ[-1] + 1 if len(differ) else 0)
    right = min(len(own) - at, len(other) - other_at)
    differ = np.flatnonzero(own[at + k:at + right] != other[other_at + k:other_at + right])
    return int(first), int(at + k + differ[0] if len(differ) else at + right)


def _parse(window: int):
    """Of rows (d, t, lo, place, words, and the reference's rd, rplace, rlo, rwords): a factor's windows (h1 null), and the windows
    at its boundaries, each with two hashes of its words."""
    w, k = shape(window)

    def run(batches):
        for b in batches:
            c = {x: b.column(i) for i, x in enumerate(b.schema.names)}
            flat, offset = np.asarray(c["words"].values), c["words"].offsets.to_numpy()
            rflat, roffset = np.asarray(c["rwords"].values), c["rwords"].offsets.to_numpy()
            d, t, lo, place, rd, rlo, rplace = (c[x].to_numpy() for x in ("d", "t", "lo", "place", "rd", "rlo", "rplace"))
            found, left = [], []
            for i in range(b.num_rows):
                own, other = flat[offset[i]:offset[i + 1]], rflat[roffset[i]:roffset[i + 1]]
                first, end = longest_factor(own, place[i] - lo[i], other, rplace[i] - rlo[i], k)
                windows = len(own) - window + 1
                inside = range(first, end - window + 1)
                if len(inside) and d[i] > rd[i]:
                    found.append((d[i], t[i], lo[i] + first, len(inside)))
                rest = np.array([x for x in range(windows) if x not in inside], np.int64)
                if len(rest):
                    u = own.view(_U)
                    h1, h2 = (mix(spans(sums(u, base), rest, rest + window, base)).view(np.int64) for base in _BASES)
                    left.append((h1, h2, np.full(len(rest), d[i]), np.full(len(rest), t[i]), rest + lo[i]))
            if found:
                x = np.array(found, np.int64)
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *[pa.array(x[:, j]) for j in range(4)]], ["h1", "h2", "d", "t", "lo", "n"])
            if left:
                x = [np.concatenate(y) for y in zip(*left)]
                yield pa.RecordBatch.from_arrays([*[pa.array(y) for y in x], pa.array(np.ones(len(x[0]), np.int64))], ["h1", "h2", "d", "t", "lo", "n"])

    return run


def repeated(k: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, t, lo, n): windows lo to lo + n - 1 of the texts (d, t, data) that also start in a text with a smaller d."""
    found = common.materialize(k.where(F.octet_length("data") >= 2 * window - 1).mapInArrow(_find_runs(window), "seed long, f long, d long, t long, lo long, n long, place long"), "runs", rows=1000)
    index = found.groupBy("seed").agg(F.min(F.struct("d", "t", "lo", "n", "place", "f")).alias("r"), F.max("d").alias("last")).where("last > r.d")
    index = common.materialize(index.select("seed", *[F.col(f"r.{c}").alias(f"r{c}") for c in ("d", "t", "lo", "n", "place", "f")]), "index")
    met = common.materialize(found.join(index, "seed").where("not (d = rd and f = rf)").select("seed", "d", "t", "lo", "n", "place", (F.col("f") == F.col("rf")).alias("same")), "met")
    apart = met.where("not same")
    needed = apart.select("seed").distinct()
    wanted = apart.select("seed", "d", "t", "lo", "n", "place", F.lit(0).alias("role")).unionByName(
        index.join(needed, "seed", "left_semi").select("seed", F.col("rd").alias("d"), F.col("rt").alias("t"), F.col("rlo").alias("lo"), F.col("rn").alias("n"), F.col("rplace").alias("place"), F.lit(1).alias("role")))
    of_text = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("seed", "lo", "n", "place", "role")).alias("parts"))  # of one document
    texts = k.join(of_text.hint("shuffle_hash"), ["d", "t"]).select("d", "t", "data", "parts")
    cut = common.materialize(texts.mapInArrow(_cut_out(window), _CUT), "contexts", rows=1000)
    # written, so that the join below has an exchange on either side and a seed of very many runs can be split
    reference = cut.where("role = 1").dropDuplicates(["seed"]).select("seed", F.col("d").alias("rd"), F.col("lo").alias("rlo"), F.col("place").alias("rplace"), F.col("words").alias("rwords"))
    reference = common.materialize(reference, "reference", rows=1000)
    pairs = cut.where("role = 0").join(reference, "seed").select("d", "t", "lo", "place", "words", "rd", "rlo", "rplace", "rwords")
    parsed = common.materialize(pairs.mapInArrow(_parse(window), "h1 long, h2 long, d long, t long, lo long, n long"), "factors", rows=10_000)
    edge = parsed.where("h1 is not null")
    earliest = edge.groupBy("h1", "h2").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("h1", "h2", "least")
    late = edge.join(earliest, ["h1", "h2"]).where("d > least").select("d", "t", "lo", "n")
    return met.where("same").select("d", "t", "lo", "n").unionByName(parsed.where("h1 is null").select("d", "t", "lo", "n")).unionByName(late)


def _kept(window: int):
    def run(batches):
        for b in batches:
            names = b.schema.names
            at = {x: names.index(x) for x in ("_data", "_at", "_n")}
            kept, words, removed = [], [], []
            for data, lo, n in zip(b.column(at["_data"]), b.column(at["_at"]), b.column(at["_n"])):
                found = words_of(data.as_buffer())
                stay = np.ones(len(found), bool)
                if lo.is_valid and len(lo.values):
                    edge = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edge, np.asarray(lo.values), 1)
                    np.add.at(edge, np.asarray(lo.values) + np.asarray(n.values) + window - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    kept.append(b" ".join([x for x, s in zip(found, stay.tolist()) if s]))
                else:
                    kept.append(b" ".join(found))
                words.append(len(found))
                removed.append(len(found) - int(stay.sum()))
            rest = [(x, c) for x, c in zip(names, b.columns) if x not in at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())],
                                             [*[x for x, _ in rest], "kept", "n_words", "n_removed"])

    return run


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without text, plus kept (the words that stay, joined by spaces), n_words and n_removed.

    Each word goes that a stretch of `window` words covers which also starts in a document with a smaller doc_id; stretches are
    judged on the input. Null texts have no words; null ids come last and are one document's to each other, as are rows that
    repeat an id, so none of these is cut for another. Texts of any length are read whole. Every row stays; columns
    that clash with the new names are dropped; an empty table gives no rows.
    """
    own = keys(repeats := ids_repeat(docs))
    k = docs.select(*own)
    k = k.dropDuplicates(["d", "t"]) if repeats else k
    new = ("kept", "n_words", "n_removed", "_d", "_t", "_data", "_at", "_n")
    gone = repeated(k, window).groupBy("d", "t").agg(F.collect_list("lo").alias("_at"), F.collect_list("n").alias("_n"))  # of one document
    gone = gone.select(F.col("d").alias("_d"), F.col("t").alias("_t"), "_at", "_n")
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*new, "text")], *[c.alias(f"_{x}") for c, x in zip(own, ("d", "t", "data"))])
    common.bounded_batches(docs.sparkSession)
    j = d.join(gone.hint("shuffle_hash"), ["_d", "_t"], "left").drop("_d", "_t")
    fields = [f for f in j.schema.fields if f.name not in ("_data", "_at", "_n")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["kept string", "n_words long", "n_removed long"])
    return j.mapInArrow(_kept(window), schema)


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_passages(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
