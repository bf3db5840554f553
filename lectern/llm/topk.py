"""Exact BM25 top-k: an inverted index for each shard, block-max WAND pruning, an exact merge.

A task indexes what it reads, shard by shard, and writes each index to the shared folder; only document
frequencies are shuffled. Queries go in blocks, with weights from the statistics of all documents.

A block of queries is searched in a shard at once. First each block of documents gets a bound for each query:
the sum of its terms' largest impacts there. Pairs of a query and a block of documents whose bound is below the
query's k-th score so far are left out. In the rest the terms are taken up from the rarest on, document by
document; the frequent ones behind the pivot, whose largest impacts together stay below the k-th score, are
summed only for documents that a term before the pivot has and that can still reach that score. Those that can
after all sums are scored exactly, in double precision.

Thresholds are carried: each block of queries is searched in two shards first, and what it has found there is
the k-th score with which all other shards begin. A task then takes a group of shards, builds what it needs of
each once, and searches some blocks of queries in it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, lm

K1, B = 1.2, 0.75
K = 10
#: Documents and words of a shard at most, documents of a block (as a power of two), queries of a block.
SHARD_DOCS, SHARD_WORDS, BITS, BLOCK = 8192, 6_000_000, 6, 512
#: Shards and blocks of queries that a task takes, shards that set thresholds, queries that make a block of one leading term.
GROUP, CHUNK, FIRST, LED = 8, 8, 2, 256
#: A term's impacts are kept as a row of numbers if one of so many documents (or blocks) has it, up to so many numbers a shard.
OFTEN, OFTEN_BLOCKS, CELLS = 100, 10, 6_000_000
#: Part of the k-th score that the terms behind the pivot may make up; (query, term) pairs of a block of queries.
PIVOT, PAIRS = 0.3, 400_000


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words (A-Z lower-cased, split at white space) and how many each text has."""
    toks, count = lm.tokens(texts)
    inner = np.ones(len(toks), bool)
    inner[np.cumsum(count) - 1] = False
    return toks[inner], count - 1


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at start and have size members, one after the other."""
    at = np.cumsum(size, dtype=start.dtype)
    return np.repeat(start - at + size, size) + np.arange(at[-1] if len(at) else 0, dtype=start.dtype)


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(x.max() if len(x) else 0))


def postings(toks: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Postings by term and by document; documents are renumbered so that alike ones share blocks: by that of their terms
    which most documents have, then by length."""
    n = len(count)
    terms, own = np.unique(toks, return_inverse=True)
    v = max(1, len(terms))
    code, tf = np.unique(np.repeat(np.arange(n), count) * v + own, return_counts=True)
    doc, term = np.divmod(code, v)
    start = np.searchsorted(doc, np.arange(n + 1))
    spread_ = np.bincount(term, minlength=v)
    lead = np.full(n, -1)
    some = start[1:] > start[:-1]
    if some.any():
        lead[some] = np.maximum.reduceat(spread_[term] * v + term, start[:-1][some])
    place = np.empty(n, np.int64)
    place[np.lexsort((count, lead))] = np.arange(n)
    size = np.diff(start)
    length, width = np.empty(n, np.int64), np.empty(n, np.int64)
    length[place], width[place] = count, size
    fstart = np.concatenate(([0], np.cumsum(width)))
    own = np.empty(len(doc), np.int64)  # by document, its terms in order
    own[spread(fstart[place], size)] = np.arange(len(doc))
    forward = {"fstart": fstart, "fterm": term[own].astype(np.int32), "ftf": narrow(tf[own])}
    order = np.argsort(term[own], kind="stable")
    doc = narrow(np.repeat(np.arange(n), width))
    return {"terms": terms, "start": np.concatenate(([0], np.cumsum(spread_[:len(terms)]))), "doc": doc[order], "tf": forward["ftf"][order], "length": length, "place": place} | forward


_BUILT = pa.schema([("kind", pa.int32()), ("term", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("path", pa.string())])


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    head = head.ljust(-(-len(head) // 64) * 64)
    parts = [np.array([len(head)], "<i8"), np.frombuffer(head, np.uint8)]
    for v in arrays.values():
        raw = np.ascontiguousarray(v).view(np.uint8)
        parts += [raw, np.zeros(-len(raw) % 8, np.uint8)]
    return lm._create(folder, uuid.uuid4().hex, *parts)


def _load(path: str) -> dict[str, np.ndarray]:
    m = lm._mapped(path)
    size = int(m[:8].view("<i8")[0])
    out, at = {}, 8 + size
    for name, kind, n in (x.split(",") for x in bytes(m[8:at]).decode().strip().split(";")):
        width = int(n) * np.dtype(kind).itemsize
        out[name] = m[at:at + width].view(kind)
        at += -(-width // 8) * 8
    return out


def _indexer(folder: str):
    """Rows (kind, term, n, words, path): kind 0 a shard's file, documents and words; kind 1 a term's documents."""
    def flush(held):
        ids = np.concatenate([h[0] for h in held])
        p = postings(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        held.clear()
        place = p.pop("place")
        own = np.empty_like(ids)
        own[place] = ids
        path = _save(folder, p | {"ids": own})
        yield pa.RecordBatch.from_pylist([{"kind": 0, "term": None, "n": len(ids), "words": int(p["length"].sum()), "path": path}], _BUILT)
        df = np.diff(p["start"])
        for lo in range(0, len(df), 200_000):
            part = df[lo:lo + 200_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int32)), pa.array(p["terms"][lo:lo + 200_000].view(np.int64)), pa.array(part), none, none.cast(pa.string())], schema=_BUILT)

    def run(batches):
        held, docs, size = [], 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                toks, count = words([t or b"" for t in part.column(1).to_pylist()])
                held.append((part.column(0).to_numpy(zero_copy_only=False), toks, count))
                docs, size = docs + len(count), size + len(toks)
                if docs >= SHARD_DOCS or size >= SHARD_WORDS:
                    yield from flush(held)
                    docs = size = 0
        if held:
            yield from flush(held)
    return run


NO_ID = (1 << 63) - 1


def index(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The shards' files, written to a folder, and every term's document frequency in each shard."""
    folder = folder or common.scratch(docs.sparkSession, "index")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    return common.materialize(d.mapInArrow(_indexer(folder), "kind int, term long, n long, words long, path string"), "index", rows=1000, mb=8)


def _query_terms(batches):
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
        toks, count = words(texts)
        at = 0
        for i, c in zip(ids, count.tolist()):
            t, n = np.unique(toks[at:at + c], return_counts=True)
            at += c
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i, np.int64)), pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], ["query_id", "term", "qtf"])


def _block_writer(folder: str):
    """A file for each block of queries, from rows (block, query_id, term, weight) sorted by block, query and how many documents have the term."""
    def flush(block, held):
        q, t, w = (np.concatenate(x) for x in zip(*held))
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        terms, own = np.unique(t.view(np.uint64), return_inverse=True)
        start = np.append(first, len(q))
        query = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(start))
        path = _save(folder, {"ids": q[first], "start": start, "terms": terms, "own": own.astype(np.int32), "query": query, "w": w})
        return pa.RecordBatch.from_pylist([{"block": block, "path": path}], pa.schema([("block", pa.int64()), ("path", pa.string())]))

    def run(batches):
        now, held = None, []
        for b in batches:
            block = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held and block[lo] != now:
                    yield flush(now, held)
                    held = []
                now = int(block[lo])
                held.append([b.column(i).to_numpy()[lo:hi] for i in (1, 2, 3)])
        if held:
            yield flush(now, held)
    return run


class Shard:
    """A shard's postings with impacts, their largest in each block of documents, and the frequent terms' as matrices."""

    def __init__(self, s: dict[str, np.ndarray], mean: float):
        self.s, self.terms, self.ids, self.n = s, s["terms"], s["ids"], len(s["ids"])
        self.norm = K1 * (1 - B + B * s["length"] / mean) if mean else np.ones(self.n)
        self.blocks = -(-self.n // (1 << BITS))
        self.doc, start = s["doc"].astype(np.int32), s["start"]
        tf = s["tf"].astype(np.float32)
        self.impact = tf * np.float32(K1 + 1) / (tf + self.norm.astype(np.float32)[self.doc])
        self.size = np.diff(start)
        term = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        group, self.low = self.doc >> BITS, (self.doc & ((1 << BITS) - 1)).astype(np.int16)
        self.first = (np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (term[1:] != term[:-1])))) if len(term) else np.zeros(0)).astype(np.int32)
        self.block = group[self.first]
        self.count = np.diff(np.append(self.first, np.int32(len(term))))
        self.most = np.maximum.reduceat(self.impact, self.first) if len(self.first) else np.zeros(0, np.float32)
        self.at = np.searchsorted(self.first, start).astype(np.int32)
        self.entries = np.diff(self.at)
        self.top = np.maximum.reduceat(self.most, self.at[:-1]) if len(self.first) else self.most
        self.row, self.dense = self._rows(self.size, OFTEN, term, self.doc, self.impact, self.blocks << BITS)
        self.block_row, self.block_dense = self._rows(self.entries, OFTEN_BLOCKS, term[self.first], self.block, self.most, self.blocks)
        self.weight, self.mark = np.zeros(len(self.size)), np.zeros(len(self.size), bool)

    @staticmethod
    def _rows(size: np.ndarray, often: int, term: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Which row each term has (-1: none), and the rows of those that more than one in `often` columns have."""
        use = np.flatnonzero(size * often >= max(1, columns))
        room = CELLS // max(1, columns)
        if len(use) > room:
            use = np.sort(use[np.argpartition(-size[use], room)[:room]])
        row = np.full(len(size), -1, np.int32)
        row[use] = np.arange(len(use))
        dense = np.zeros((len(use), columns), np.float32)
        own = row[term]
        hit = own >= 0
        dense[own[hit], column[hit]] = value[hit]
        return row, dense

    @staticmethod
    def _product(query: np.ndarray, row: np.ndarray, w: np.ndarray, queries: int, dense: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """The queries' sums over rows: weights (query, row, w) times those rows, at some columns (groups of them) only."""
        used = np.zeros(len(dense), bool)
        used[row] = True
        weight = np.zeros((queries, used.sum()), np.float32)
        weight[query, (np.cumsum(used) - 1)[row]] = w
        if columns is None:
            return weight @ dense[used]
        part = dense.reshape(len(dense), dense.shape[1] >> BITS, 1 << BITS)[np.ix_(used, columns)]
        return weight @ part.reshape(len(part), len(columns) << BITS)

    def _entries(self, query: np.ndarray, term: np.ndarray, w: np.ndarray, most: int = 1 << 19):
        """Parts of the (term, block) entries of terms of queries: the number of query and block, the weight, the entry."""
        done = np.cumsum(self.entries[term], dtype=np.int64)
        edge = np.searchsorted(done, np.arange(0, (done[-1] if len(done) else 0) + most, most), "right")
        base = query * np.int32(self.blocks)
        for lo, hi in zip(edge, edge[1:]):
            if lo < hi:
                size = self.entries[term[lo:hi]]
                e = spread(self.at[term[lo:hi]], size)
                yield np.repeat(base[lo:hi], size) + self.block[e], np.repeat(w[lo:hi], size), e

    def _bound(self, query: np.ndarray, term: np.ndarray, w: np.ndarray, row: np.ndarray, use: np.ndarray, queries: int) -> np.ndarray:
        """The sums, for each query and block, of the largest impacts of the terms in use."""
        d = use & (row >= 0)
        bound = self._product(query[d], row[d], w[d], queries, self.block_dense)
        d = use & (row < 0)
        for pair, weight, e in self._entries(query[d], term[d], w[d]):
            np.add.at(bound.reshape(-1), pair, weight * self.most[e])
        return bound

    def search(self, q: dict[str, np.ndarray], k: int, best: list[tuple[np.ndarray, np.ndarray]], theta: np.ndarray, places: int | None = None) -> None:
        """Brings the k best of each query of a block, and the k-th scores, up to what this shard has. With places, scores are
        rounded before they are ranked; the k-th scores are then the least that can round to the k-th."""
        unit = 0 if places is None else 10.0 ** -places
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, q["terms"]), len(self.terms) - 1)
        at = np.where(self.terms[at] == q["terms"], at, -1)[q["own"]]
        has = np.flatnonzero(at >= 0)
        term, query, exact_w = at[has].astype(np.int32), q["query"][has], q["w"][has]
        w, queries = exact_w.astype(np.float32), len(q["ids"])
        # single precision: bounds are raised by more than the error of a sum of so many positive numbers
        slack = 1 + (np.diff(q["start"]) + 32) * 2.4e-7
        row, block_row = self.row[term], self.block_row[term]
        rare_bound = self._bound(query, term, w, block_row, row < 0, queries)
        bound = rare_bound + self._bound(query, term, w, block_row, row >= 0, queries)
        least = np.maximum(theta / slack, 1e-30)
        open_ = bound >= least[:, None]
        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            return
        # terms behind the pivot: the most frequent of a query, as long as their largest impacts stay below a part of the k-th score
        gain = np.cumsum(exact_w * self.top[term])
        start = np.searchsorted(query, np.arange(queries + 1))
        gain -= np.concatenate(([0.0], gain))[start[:-1]][query]
        behind = (row >= 0) & (block_row >= 0) & (gain < PIVOT * theta[query])
        to_row, to_column = np.cumsum(open_.any(1)) - 1, np.cumsum(open_.any(0)) - 1
        d = (row >= 0) & ~behind & open_.any(1)[query]
        total = self._product(to_row[query[d]], row[d], w[d], len(rows), self.dense, None if len(columns) == self.blocks else columns)
        total = total.reshape(len(rows), len(columns), 1 << BITS)
        rest = self._product(query[behind], block_row[behind], w[behind], queries, self.block_dense)[np.ix_(rows, columns)]
        # rare terms are summed only where, by their largest impacts in the block, some document can still reach the k-th score
        open_[np.ix_(rows, columns)] &= total.max(2) + rest + rare_bound[np.ix_(rows, columns)] >= least[rows][:, None]
        cells = np.full((queries, self.blocks), -1, np.int32)
        cells[np.ix_(rows, columns)] = np.arange(len(rows) * len(columns), dtype=np.int32).reshape(len(rows), -1) << BITS
        cells[~open_] = -1
        d, cells = row < 0, cells.ravel()
        for pair, weight, e in self._entries(query[d], term[d], w[d]):
            cell = cells[pair]
            use = np.flatnonzero(cell >= 0)
            e = e[use]
            size = self.count[e]
            p = spread(self.first[e], size)
            np.add.at(total.reshape(-1), np.repeat(cell[use], size) + self.low[p], np.repeat(weight[use], size) * self.impact[p])
        near = total >= (least[rows][:, None] - rest)[:, :, None]
        near &= total > 0
        for i in np.flatnonzero(near.sum((1, 2)) > 2 * k):  # sums so far are lower bounds too
            known = total[i][near[i]]
            floor = np.partition(known, len(known) - k)[len(known) - k] / slack[rows[i]] ** 2 - unit
            if floor > least[rows[i]]:
                near[i] &= total[i] >= (floor - rest[i])[:, None]
                theta[rows[i]] = max(theta[rows[i]], floor)
        found, column, place = np.nonzero(near)
        edge = np.searchsorted(found, np.arange(len(rows) + 1))
        doc = (columns[column] << BITS) + place
        for i in np.flatnonzero(edge[1:] > edge[:-1]):
            r, own = rows[i], doc[edge[i]:edge[i + 1]]
            sums = self._exact(own, term[start[r]:start[r + 1]], exact_w[start[r]:start[r + 1]])
            if unit:
                sums = np.floor(sums / unit + 0.5) * unit
            hit = sums >= theta[r]
            score, ids = np.concatenate((best[r][0], sums[hit])), np.concatenate((best[r][1], self.ids[own[hit]]))
            keep = np.lexsort((ids, -score))[:k]
            best[r] = score[keep], ids[keep]
            if len(keep) == k:
                theta[r] = max(theta[r], score[keep[-1]] - 0.51 * unit)

    def _exact(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of documents, each summed over its terms in order."""
        self.weight[term], self.mark[term] = w, True
        lo, hi = self.s["fstart"][doc], self.s["fstart"][doc + 1]
        terms = np.concatenate([self.s["fterm"][x:y] for x, y in zip(lo.tolist(), hi.tolist())])
        hit = np.flatnonzero(self.mark[terms])
        done = np.cumsum(hi - lo)
        own = np.searchsorted(done, hit, "right")
        tf = self.s["ftf"][hit + (hi - done)[own]].astype(np.float64)
        out = np.bincount(own, self.weight[terms[hit]] * (tf * (K1 + 1) / (tf + self.norm[doc[own]])), len(doc))
        self.mark[term] = False
        return out


_FOUND = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("path", pa.string()), ("theta", pa.string())])


def _search(k: int, mean: float, folder: str, places: int | None):
    """From rows (blocks of queries, their thresholds if known, shards) what each block has found, and a row that names its thresholds."""
    def run(batches):
        for b in batches:
            for blocks, known, shards in zip(*(b.column(i).to_pylist() for i in range(3))):
                read = [_load(x) for x in blocks]
                theta = [_load(x)["theta"].copy() if x else np.zeros(len(q["ids"])) for x, q in zip(known, read)]
                best = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in q["ids"]] for q in read]
                for path in shards:
                    s = Shard(_load(path), mean)
                    for q, found, least in zip(read, best, theta):
                        s.search(q, k, found, least, places)
                for block, before, q, found, least in zip(blocks, known, read, best, theta):
                    size = [len(x[0]) for x in found]
                    none = pa.nulls(sum(size), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q["ids"], size)), pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[0] for x in found])), none, none], schema=_FOUND)
                    if not before:
                        yield pa.RecordBatch.from_pylist([{"query_id": None, "doc_id": None, "score": None, "path": block, "theta": _save(folder, {"theta": least})}], _FOUND)
    return run


_FOUND_DDL = "query_id long, doc_id long, score double, path string, theta string"


def _blocks(terms: DataFrame, built: DataFrame, n: int, folder: str) -> DataFrame:
    """The files of the blocks of queries, written to a folder. Queries whose most widespread term is the same go together, which as a rule are
    of one language, so that they ask for the same terms and blocks of documents; those of seldom leading terms are pooled."""
    df = built.where("kind = 1").groupBy("term").agg(F.sum("n").alias("df")).join(terms.select("term").distinct(), "term", "left_semi")
    weighed = common.materialize(terms.join(df, "term").select("query_id", "term", "df", (F.col("qtf") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w")), "weighed")
    led = weighed.groupBy("query_id").agg(F.max_by("term", F.struct("df", "term")).alias("lead"), F.count(F.lit(1)).alias("pairs"))
    size = led.groupBy("lead").agg(F.count(F.lit(1)).alias("queries")).where(F.col("queries") >= LED).select("lead", F.col("lead").alias("pool"))
    led = led.join(size, "lead", "left").select("query_id", "pairs", F.coalesce("pool", F.lit(0)).alias("pool"))
    parts = led.groupBy("pool").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("pairs") / PAIRS)).alias("parts"))
    block = F.xxhash64("pool", F.pmod(F.xxhash64("query_id"), "parts")).alias("block")
    rows = weighed.join(led.join(parts, "pool").select("query_id", block), "query_id").select("block", "query_id", "term", "w", "df")
    rows = rows.repartition("block").sortWithinPartitions("block", "query_id", F.desc("df"), "term").drop("df")
    return common.materialize(rows.mapInArrow(_block_writer(folder), "block long, path string"), "blocks", rows=100_000)


def search(queries: DataFrame, docs: DataFrame, k: int = K, once: bool = False, places: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k documents of the largest BM25 score for each query (query_id, text).

    Every word of a query counts, as often as it stands there; idf is ln(1 + (N - df + 0.5) / (df + 0.5)); only
    documents that share a word are returned. Ties go to the smaller doc_id, a null doc_id last. Null texts
    have no words. Every row of docs is a candidate of its own; query rows that share an id are one query; a
    null query id is no query; extra columns are ignored; empty tables give no rows. With `once` a word of a query counts
    once, however often it stands there; with `places` scores are rounded before they are ranked.
    """
    spark = docs.sparkSession
    shards_folder, blocks_folder, folder = (common.scratch(spark, x) for x in ("shards", "queries", "thresholds"))
    built = index(docs, shards_folder)
    n, total, files = built.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    q = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    terms = common.materialize(q.mapInArrow(_query_terms, "query_id long, term long, qtf long").groupBy("query_id", "term").agg((F.lit(1) if once else F.sum("qtf")).cast("long").alias("qtf")), "terms", rows=1000, mb=8)
    blocks = _blocks(terms, built, n, blocks_folder)
    first = sorted(r[0] for r in built.where("kind = 0").select("path").orderBy("path").limit(FIRST).collect())
    run = _search(k, total / n if n else 0.0, folder, places)
    one = blocks.select(F.array("path").alias("blocks"), F.array(F.lit(None).cast("string")).alias("theta"), F.array(*map(F.lit, first)).cast("array<string>").alias("shards"))
    count = blocks.count()
    begun = common.materialize(one.repartition(max(1, count)).mapInArrow(run, _FOUND_DDL), "begun", rows=1)
    chunks, groups = max(1, -(-count // CHUNK)), -(-max(0, files - FIRST) // GROUP)
    found = begun.where("path is null")
    if groups:
        known = begun.where("path is not null").groupBy(F.pmod(F.xxhash64("path"), F.lit(chunks)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("path", "theta"))).alias("b"))  # about CHUNK names
        shards = built.where(F.col("kind").eqNullSafe(0) & ~F.col("path").isin(first)).groupBy(F.pmod(F.xxhash64("path"), F.lit(groups)).alias("part")).agg(F.sort_array(F.collect_list("path")).alias("shards"))  # about GROUP names
        pairs = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(shards, "part")
        pairs = pairs.repartitionById(chunks * groups, (F.col("chunk") * groups + F.col("part")).cast("int"))
        rest = common.materialize(pairs.select("b.path", "b.theta", "shards").mapInArrow(run, _FOUND_DDL), "found", rows=1)
        found = found.unionByName(rest)
    common.remove(spark, shards_folder, blocks_folder, folder)  # all that was found is written
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of the documents whose doc_id is divisible by 50, against all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), docs)
    return found.withColumn("score", F.round("score", 6))


OP8_SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{common.ASCII_UPPER}', '{common.ASCII_UPPER.lower()}'), '[^\x20\x09-\x0D]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(size) FROM len)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT word, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, total GROUP BY word),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * {K1 + 1}::DOUBLE / (d.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * size / mean))), 6) AS score
  FROM tf q JOIN idf USING (word) JOIN tf d USING (word) JOIN len ON len.doc_id = d.doc_id, total WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
