"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard, beam search.

Within a shard every vector gets one more component that lifts it to the largest norm, so that the largest
inner product is the smallest angle, and the graph is built on one sphere. Equal vectors are one node.

A task that builds a shard writes its vectors and graph to the shared folder, and so does one that has gathered
a block of queries: what is dealt out for the search are pairs of names. The tasks of the search map both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import retrieval

from . import common
from .topk import _load as load, _save as save

#: Nodes of a shard, edges of a node, beam of a search, relaxation of the pruning, queries of a block.
SHARD, DEGREE, BEAM, ALPHA, BLOCK = 4096, 32, 64, 1.2, 1024
K = 20
#: Shards whose names are gathered in one row before they meet the blocks of queries.
FAN = 64
SALTS = 16
#: Nodes that one step expands for each query.
STEP = 4
NONE = np.float32(-np.inf)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int = BEAM, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the `beam` best nodes found and their inner products, best first; -1 where none.

    All queries advance together: each step expands the best nodes of every beam that it has not expanded yet.
    """
    n, m = len(x), len(q)
    ids = np.full((m, beam), -1, np.int32)
    s = np.full((m, beam), NONE, np.float32)
    seen = np.zeros((m, n), bool)
    first = np.arange(n) if n <= beam else np.array([entry])
    ids[:, :len(first)] = first
    s[:, :len(first)] = q @ x[first].T
    seen[:, first] = True
    fresh = ids >= 0
    live = np.arange(m)
    while len(live):
        rank = np.where(fresh[live], s[live], NONE)
        top = np.argpartition(-rank, step - 1, axis=1)[:, :step] if beam > step else np.tile(np.arange(beam), (len(live), 1))
        node = np.take_along_axis(ids[live], top, 1)
        ok = np.take_along_axis(fresh[live], top, 1)
        fresh[live[:, None], top] = False
        near = graph[np.where(ok, node, 0)]
        near = np.where(ok[:, :, None], near, -1).reshape(len(live), -1)
        at = np.maximum(near, 0)
        new = (near >= 0) & ~seen[live[:, None], at]
        order = np.sort(np.where(new, near, n + np.arange(near.shape[1])), axis=1)  # a node found twice counts once
        new = np.concatenate((order[:, :1] < n, (order[:, 1:] < n) & (order[:, 1:] != order[:, :-1])), axis=1)
        at = np.where(new, order, 0)
        seen[np.broadcast_to(live[:, None], at.shape)[new], at[new]] = True
        got = np.full(at.shape, NONE, np.float32)
        r, c = np.nonzero(new)
        got[r, c] = np.einsum("ij,ij->i", x[at[r, c]], q[live[r]])
        every = np.concatenate((s[live], got), 1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        s[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(new, at, -1).astype(np.int32)), 1), best, 1)
        fresh[live] = np.take_along_axis(np.concatenate((fresh[live], new), 1), best, 1)
        live = live[fresh[live].any(1)]
    order = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of the nodes `own`, chosen from rows of candidates (-1: none): the nearest is kept and
    takes with it all that are nearer to it, by the factor alpha, than to the node; then the next."""
    cand = np.where(cand == own[:, None], -1, cand)
    cand = np.sort(cand, axis=1)[:, ::-1].copy()
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.maximum(cand, 0)]
    top = np.einsum("bd,bcd->bc", x[own], v)
    norm = float(x[0] @ x[0])
    to_own = np.where(cand >= 0, 2 * (norm - top), np.inf)
    order = np.argsort(to_own, axis=1, kind="stable")
    cand, to_own = np.take_along_axis(cand, order, 1), np.take_along_axis(to_own, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = 2 * (norm - np.matmul(v, v.transpose(0, 2, 1)))
    alive = cand >= 0
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        out[has, k] = cand[rows, pick][has]
        alive &= ~((alpha * alpha * between[rows, pick] <= to_own) & has[:, None])
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph, entry) over the rows of x, which have one norm: from a random graph, each node searches for
    itself, keeps a pruned choice of what it meets, and is offered to those as a neighbour; once plain, once relaxed."""
    n = len(x)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    graph = rng.integers(0, n, (n, degree)).astype(np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    entry = int(np.argmax(x @ x.mean(0)))
    if n == 1:
        return np.full((1, 1), -1, np.int32), 0
    for a in (1.0, alpha):
        turn = rng.permutation(n)
        for lo in range(0, n, batch):
            own = turn[lo:lo + batch]
            found, _ = beam_search(x, graph, entry, x[own], beam)
            graph[own] = robust_prune(x, own, np.concatenate((found, graph[own]), 1), degree, a)
            to, by = graph[own].ravel(), np.repeat(own, degree)
            to, by = to[to >= 0], by[to >= 0]
            order = np.argsort(to, kind="stable")
            to, by = to[order], by[order]
            node, start = np.unique(to, return_index=True)
            count = np.diff(np.append(start, len(to)))
            place = np.arange(len(to)) - np.repeat(start, count)
            offered = np.full((len(node), count.max()), -1, np.int32)
            offered[np.repeat(np.arange(len(node)), count), place] = by
            for part in range(0, len(node), batch):
                p = node[part:part + batch]
                graph[p] = robust_prune(x, p, np.concatenate((graph[p], offered[part:part + batch]), 1), degree, a)
    return graph, entry


def lifted(v: np.ndarray) -> np.ndarray:
    """Single-precision rows of one norm: another component makes up what each lacks."""
    square = (v * v).sum(1)
    most = square.max()
    return np.concatenate((v, np.sqrt(np.maximum(most - square, 0))[:, None]), 1).astype(np.float32) / np.float32(np.sqrt(most))


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, each summed from the first component to the last."""
    s = np.zeros(len(q))
    for k in range(q.shape[1]):
        s += q[:, k] * v[:, k]
    return s


_NAMES = "dim int, part long, path string"
_NAMED = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("path", pa.string())])


def _named(key, path: str) -> pa.Table:
    return pa.Table.from_pylist([{"dim": key[0].as_py(), "part": key[1].as_py(), "path": path}], _NAMED)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _build(folder: str, degree: int, beam: int, alpha: float):
    """Writes a shard: vectors, graph, entry, and each node's ids."""
    def run(key, table):
        v = _matrix(table.column("e"))
        graph, entry = build(lifted(v), degree, beam, alpha)
        ids = table.column("members").combine_chunks()
        return _named(key, save(folder, {"v": v.ravel(), "graph": graph.ravel(), "entry": np.array([entry]), "ids": np.asarray(ids.flatten()), "many": np.diff(ids.offsets.to_numpy())}))
    return run


def _gather(folder: str):
    """Writes a block of queries."""
    def run(key, table):
        ids, tags = (table.column(c).to_numpy() for c in ("vec_id", "tag"))
        return _named(key, save(folder, {"ids": ids, "tags": tags, "q": _matrix(table.column("e")).ravel()}))
    return run


def _search(k: int, beam: int):
    def run(batches):
        for b in batches:
            for dim, shard, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                s, block = load(shard), load(block)
                v, own, tag = s["v"].reshape(-1, dim), block["ids"], block["tags"]
                q = block["q"].reshape(-1, dim)
                ids, _ = beam_search(lifted(v), s["graph"].reshape(len(v), -1), int(s["entry"][0]), np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32), max(beam, k + 1))
                at, c = np.nonzero(ids >= 0)
                node = ids[at, c]
                score = exact(q[at], v[node])
                size, flat = s["many"], s["ids"]
                first = np.cumsum(size) - size
                many = size[node]
                at, score, start = np.repeat(at, many), np.repeat(score, many), np.repeat(first[node], many)
                vec = flat[start + np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)]
                other = vec != own[at]
                at, score, vec = at[other], score[other], vec[other]
                order = np.lexsort((vec, -score, at))
                at, score, vec = at[order], score[order], vec[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                keep = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(own[at[keep]]), pa.array(tag[at[keep]]), pa.array(vec[keep]), pa.array(score[keep])], ["query_id", "tag", "vec_id", "score"])
    return run


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and e of the vectors that take part: not null, not zero, all components finite."""
    e = F.col(vec).cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)) & F.exists(e, lambda c: c != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).distinct()


def index(vectors: DataFrame, k: int = K, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """A row for each shard: dim, part and the path of its vectors, its graph and the smallest k + 1 ids of each node.

    Every usable vector is indexed; vectors of different lengths are in different shards. A node's ids are
    taken salt by salt, so that a vector which a third of the rows share is never in one task.
    """
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")
    least = F.row_number().over(Window.partitionBy("e", "salt").orderBy("vec_id"))
    nodes = vectors.select("e", "vec_id", salt).withColumn("r", least).where(F.col("r") <= k + 1).groupBy("e").agg(
        F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("members"))  # SALTS * (k + 1) at most
    nodes = common.materialize(nodes.withColumn("dim", F.size("e")), "nodes")
    count = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}  # a row for each vector length
    shards = F.lit(1)
    for dim, n in count.items():
        shards = F.when(F.col("dim") == dim, -(-n // shard)).otherwise(shards)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("e"), shards.cast("long")))
    folder = common.scratch(vectors.sparkSession, "graphs")
    built = dealt.select("dim", "shard", "e", "members").groupBy("dim", "shard").applyInArrow(_build(folder, degree, beam, alpha), _NAMES)
    return common.materialize(built, "shards")


def search(queries: DataFrame, shards: DataFrame, k: int = K, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, e), itself left out.

    Queries go in blocks to every shard; each shard gives its best k, and those are merged. Ties go to the
    smaller vec_id. Rows that share an id but not the vector are searched one by one; a null vector, a zero one
    or one with a null or non-finite component gives no rows; an empty table gives none.
    """
    spark = queries.sparkSession
    n, parts, folder = queries.count(), shards.count(), common.scratch(spark, "queries")
    q = queries.withColumn("tag", F.xxhash64("e")).withColumn("block", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(max(1, -(-n // block)))))
    blocks = q.select(F.size("e").alias("dim"), F.col("block").cast("long").alias("part"), "vec_id", "tag", "e").groupBy("dim", "part").applyInArrow(_gather(folder), _NAMES)
    blocks = common.materialize(blocks, "blocks")
    groups = max(1, -(-parts // FAN))  # names of about FAN shards go together
    near = shards.groupBy("dim", F.pmod(F.xxhash64("part"), F.lit(groups)).alias("group")).agg(F.collect_list("path").alias("shards"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    pairs = blocks.select("dim", F.col("path").alias("block"), every).join(near, ["dim", "group"]).select("dim", F.explode("shards").alias("shard"), "block")
    found = pairs.repartition(max(1, -(-parts * blocks.count() // 4)), "shard", "block").select("dim", "shard", "block").mapInArrow(_search(k, beam), "query_id long, tag long, vec_id long, score double")
    found = common.materialize(found, "found", rows=4)
    common.remove(spark, folder)
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = common.materialize(usable(common.table(spark, sf_dir, "embeddings")), "vectors")
    return search(v.where("vec_id % 20 = 0"), index(v))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, recall) of op2_ann's neighbours against the exact ones by inner product."""
    got = op2_ann(spark, sf_dir).withColumnRenamed("vec_id", "doc")
    v = usable(common.table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("doc"), F.col("e").alias("vec"))
    best = retrieval.dense(v.where("doc % 20 = 0").withColumnRenamed("doc", "query_id"), v, K)
    return retrieval.recall_overlap(got, best, K)
