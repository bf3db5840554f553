"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LANES, WIDTH = 4, 16
SEED = 42
#: Byte lanes of one byte's bits: entry v has bit i of v in its byte i.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    joined = b" ".join(w)
    ends = list(itertools.accumulate(len(x) + 1 for x in w))
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1:])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes, run i of counts[i] hashes; bit set if in over half; no hashes: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n, starts = counts[full], np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    # pieces of at most 255 hashes, so that byte lanes do not overflow
    pieces = -(-n // 255)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    at = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    sums = np.empty((len(at), 64), np.uint8)
    bounds = np.append(at, len(hashes))
    step = 512
    for lo in range(0, len(at), step):
        hi = min(lo + step, len(at))
        part = hashes[bounds[lo]:bounds[hi]].view(np.uint8).reshape(-1, 8)
        sums[lo:hi] = np.add.reduceat(_SPREAD[part], at[lo:hi] - bounds[lo], axis=0).view(np.uint8)
    total = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    bits = (2 * total > n[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").copy().view(np.uint64).ravel()
    return out


def _fingerprint_batches(words: int):
    def run(batches):
        for batch in batches:
            hashes, counts = [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t, words)
                counts.append(len(h))
                hashes.append(np.array(h, np.uint64))
            joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            fp = majority(joined, np.array(counts, np.int64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fp)], ["doc_id", *batch.schema.names[2:], "fp"])
    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash as a signed long. Null and empty texts have fingerprint zero."""
    return _fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, "")


def _fingerprints(docs: DataFrame, words: int, more: str) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_fingerprint_batches(words), f"doc_id long, {more}fp long")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, block: int = 256):
    """Indexes of the pairs of a and b within radius bits, tile by tile: at most block rows of a at a time."""
    for lo in range(0, len(a), block):
        left, right = [], []
        for ro in range(0, len(b), block):
            i, j = np.nonzero(np.bitwise_count(a[lo:lo + block, None] ^ b[None, ro:ro + block]) <= radius)
            left.append(i + lo)
            right.append(j + ro)
        if left:
            yield np.concatenate(left), np.concatenate(right)


def spanning(nodes_a: np.ndarray, nodes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the given links: as many links as nodes at most."""
    nodes, flat = np.unique(np.concatenate((nodes_a, nodes_b)), return_inverse=True)
    i, j = flat[:len(nodes_a)], flat[len(nodes_a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _compare_tiles(radius: int):
    def flat(column):
        return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()

    def run(batches):
        for batch in batches:
            (fa, oa), (ra, _), (fb, ob), (rb, _) = (flat(batch.column(k)) for k in range(4))
            fa, fb = fa.view(np.uint64), fb.view(np.uint64)
            src, dst = [], []
            for k in range(batch.num_rows):
                x, y = slice(oa[k], oa[k + 1]), slice(ob[k], ob[k + 1])
                found = []
                for i, j in close_pairs(fa[x], fb[y], radius):
                    left, right = ra[x][i], rb[y][j]
                    differ = left != right
                    if differ.any():  # a group of near copies has as many pairs as its square: only a star is kept
                        found.append(spanning(left[differ], right[differ]))
                if found:
                    s, d = spanning(*(np.concatenate(z) for z in zip(*found)))
                    src.append(s)
                    dst.append(d)
            e = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e, *src])), pa.array(np.concatenate([e, *dst]))], ["a", "b"])
    return run


def links(distinct: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints (fp, rep): a spanning set of all
    pairs that differ in at most `radius` bits.

    Fingerprints are tiled by the population counts of their four 16-bit quarters. Two fingerprints within
    the radius have quarter counts within the radius in sum of absolute differences, so all other tile pairs
    are skipped; the rest are compared exactly. A count vector with more than `tile` fingerprints is dealt
    over several tiles, each compared with every tile in reach. The count directory has at most
    17**4 rows whatever the input, so broadcasting it is safe.
    """
    lane = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))) for k in range(LANES)]
    d = distinct.select("fp", "rep", *[c.cast("int").alias(f"p{k}") for k, c in enumerate(lane)])
    key = [f"p{k}" for k in range(LANES)]
    counts = common.materialize(d.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("chunks")), "tiles")
    small = F.broadcast(counts)  # 17**4 rows at most
    tiles = (d.join(small, key).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
             .groupBy(*key, "chunks", "chunk").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")))
    tiles = common.materialize(tiles, "tiles")
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, s)) <= radius and s >= (0,) * LANES]
    reach = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(s)]) for s in steps]))
    a = tiles.withColumn("s", reach).select(
        F.col("fps").alias("fa"), F.col("reps").alias("ra"), F.col("chunk").alias("ca"),
        (F.col("s.d0").isin(0) & F.col("s.d1").isin(0) & F.col("s.d2").isin(0) & F.col("s.d3").isin(0)).alias("same"),
        *[(F.col(k) + F.col(f"s.d{i}")).alias(k) for i, k in enumerate(key)])
    a = (a.join(small, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
         .where(~F.col("same") | (F.col("chunk") >= F.col("ca"))).drop("chunks"))
    b = tiles.select(*key, "chunk", F.col("fps").alias("fb"), F.col("reps").alias("rb"))
    common.bounded_batches(distinct.sparkSession)
    pairs = a.join(b, [*key, "chunk"]).select("fa", "ra", "fb", "rb")
    return pairs.mapInArrow(_compare_tiles(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints collapse before any comparison, so a group of copies costs one fingerprint. The
    component id is the smallest doc_id reachable over links. Null texts count as empty, empty texts have
    fingerprint zero and link like any other. A row with a null doc_id keeps its row and has the component of the
    rows with an id that share its very fingerprint; if there are none it links to nothing, connects nothing, and its component
    id is null. Repeated rows and extra columns are allowed; an empty table gives no rows.
    """
    fps = common.materialize(fingerprints(docs, words), "fps")
    return fps.join(_members(fps, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(fps: DataFrame, radius: int) -> DataFrame:
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = common.materialize(distinct, "distinct")
    roots = common.components(links(distinct.where("rep is not null"), radius), "a", "b")
    return distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id, of equal ids the one whose
    text has the smallest hash, of repeated rows one. Rows without an id are a group for each fingerprint, unless a row with
    an id has the same one."""
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    fps = common.materialize(_fingerprints(d, words, "h long, "), "fps")
    member = fps.join(_members(fps, radius), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    kept = member.groupBy(F.col("component_id").isNull().alias("none"), F.coalesce("component_id", "fp").alias("g")).agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    joined = docs.withColumn("_h", h).alias("a").join(kept.alias("b"), F.expr("a._h = b._h and cast(a.doc_id as long) <=> b._id")).select("a.*")
    return joined.dropDuplicates(["doc_id", "_h"]).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
