"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
DRIFT = 1.0
BIN = 0.05
#: Bound of the classifier: labelled rows of each class that it is fitted on.
TRAIN_ROWS = 20_000
#: Steps of the logarithm of evidence by which the calibration's cells are told apart.
CELL = 1000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Lexicon(dict):
    """Token scores: a word's own log-odds, else its stem's, else none; less the drift. A bounded cache."""

    def __init__(self, own: dict[str, float], stems: dict[str, float], drift: float = DRIFT, limit: int = 300_000):
        super().__init__()
        self.own, self.stems, self.drift, self.limit = own, stems, drift, limit

    def __missing__(self, w: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        s = self.own.get(w)
        if s is None:
            s = self.stems.get(w[:STEM], 0.0)
        self[w] = s = s - self.drift
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last), in order: one pass over the positive scores.

    Each candidate links to the last one before it whose left total is smaller, so that the search for
    a candidate to merge with skips what it cannot be; the whole scan is linear.
    """
    total = np.cumsum(scores)
    stack: list[tuple[float, float, int, int, int]] = []  # left total, right total, first, last, link
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, first = (float(total[i - 1]) if i else 0.0), float(total[i]), i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, i, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - a, f, e) for a, r, f, e, _ in stack]


def evidence(segments: list[float], n: int, lam: float, k: float) -> float:
    """-ln P of the best sum of normalised segment scores (Karlin and Altschul): how surprising a text is.

    P of the r best segments summing to t is about exp(-t) t**(r-1) / (r! (r-1)!). Every segment counts that is
    better than the best one to expect of n tokens.
    """
    best, t = 0.0, 0.0
    base = math.log(max(k * n, 1e-12))
    for r, s in enumerate(sorted(segments, reverse=True), 1):
        x = lam * s - base
        if x <= 0:
            break
        t += x
        best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) if t > 1 else t)
    return best


def _counter(batches):
    """Documents of each class that hold a word, and a stem."""
    found: Counter = Counter()

    def flush():
        rows = [(w, s, t, n) for (w, s, t), n in found.items()]
        found.clear()
        w, s, t, n = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(s, pa.bool_()), pa.array(t, pa.int32()), pa.array(n, pa.int64())], ["token", "stem", "toxic", "n"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = set(words(text))
            found.update((w, False, toxic) for w in own)
            found.update((w, True, toxic) for w in {w[:STEM] for w in own})
            if len(found) > 400_000:
                yield flush()
    yield flush()


def _train_ids(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Distinct texts to learn from (_id, toxic): at most `rows` of each class, by rank of a hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").where(held("doc_id") != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == t).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(rows) for t in (0, 1)]
    ids = F.broadcast(common.union_all(picked))  # 2 * rows at most
    texts = docs.join(ids, F.col("doc_id") == F.col("_id")).select("_id", "toxic", F.xxhash64("text").alias("h"))
    return texts.groupBy("h").agg(F.min("_id").alias("_id"), (F.avg("toxic") > 0.5).cast("int").alias("toxic")).select("_id", "toxic")


def held(column: str):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def _lexicon(train: DataFrame, n1: int, n0: int, prior: float = 4.0) -> tuple[dict, dict]:
    """Log-odds of words and stems. A stem's Dirichlet prior is the class sizes'; a word's is its stem's posterior.

    Words and stems whose log-odds are sqrt(2 ln V) standard errors from zero (what the largest of V unrelated
    ones reaches) stay, all of them; they come from the bounded training sample, so the model is bounded by its text.
    """
    counts = train.select("text", "toxic").mapInArrow(_counter, "token string, stem boolean, toxic int, n long").groupBy("stem", "token").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0"))
    counts = common.materialize(counts, "counts", rows=1000)
    share = n1 / (n1 + n0)
    least = math.sqrt(2 * math.log(max(2, counts.count())))

    def odds(p1):
        a1, a0 = F.col("y1") + prior * p1, F.col("y0") + prior * (1 - p1)
        d = F.log(a1 / a0) - math.log(n1 / n0)
        return d.alias("d"), (d / F.sqrt(1 / a1 + 1 / a0)).alias("z")

    stems = counts.where("stem").select("token", ((F.col("y1") + prior * share) / (F.col("y1") + F.col("y0") + prior)).alias("p"), "y1", "y0")
    stem_top = stems.select("token", *odds(F.lit(share))).where(F.abs("z") >= least)
    own = counts.where("not stem").withColumn("s", F.substring("token", 1, STEM)).join(stems.select(F.col("token").alias("s"), "p"), "s")
    own_top = own.select("token", *odds(F.col("p"))).where(F.abs("z") >= least)
    return {r[0]: r[1] for r in own_top.select("token", "d").collect()}, {r[0]: r[1] for r in stem_top.select("token", "d").collect()}


def _profile(lexicon):
    """Per training text: class, number of words, segment scores; and a histogram of clean texts' token scores."""
    def run(batches):
        lex = Lexicon(*lexicon.value)
        for b in batches:
            ns, segs, lo, cnt = [], [], [], []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.array([lex[w] for w in words(text)])
                ns.append(len(s))
                segs.append([x for x, _, _ in maximal_segments(s)])
                k, c = np.unique(np.round(s / BIN).astype(int), return_counts=True) if toxic == 0 else ((), ())
                lo.append(list(map(int, k)))
                cnt.append(list(map(int, c)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ns, pa.int64()), pa.array(segs, pa.list_(pa.float64())), pa.array(lo, pa.list_(pa.int64())), pa.array(cnt, pa.list_(pa.int64()))], ["toxic", "n", "segments", "bins", "counts"])
    return run


def extreme_lambda(hist: dict[int, int]) -> float:
    """The positive root of sum p e**(lambda s) = 1 over clean token scores; a rare positive score is assumed."""
    s = np.array(list(hist), float) * BIN
    p = np.array([hist[k] for k in hist], float)
    s, p = np.append(s, 8.0), np.append(p, 1.0)
    p /= p.sum()
    if (p * s).sum() >= 0:
        return 0.05
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(x * s)).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    lo = 1e-6
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, float]:
    """Weighted logistic fit a + b x with a small ridge on b, by damped Newton steps."""
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum() - ridge * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 4 / max(abs(da), 1e-9), 2 / max(abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(max(b, 0.0))


class Model:
    """A fitted scorer: lexicon, extreme-value parameters, logistic calibration."""

    def __init__(self, own, stems, lam, k, a, b):
        self.own, self.stems, self.lam, self.k, self.a, self.b = own, stems, lam, k, a, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from labelled, not held-out documents; None if there is not a document of each class.

    The classifier is fitted on at most `rows` labelled rows of each class; everything that it is applied to is
    read whole.
    """
    spark = docs.sparkSession
    ids = common.materialize(_train_ids(docs, labels, rows), "train")
    train = common.materialize(docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(F.col("text").cast("string").alias("text"), "toxic", "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic"), "train")
    n = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return None
    own, stems = _lexicon(train, n1, n0)
    sent = spark.sparkContext.broadcast((own, stems))
    profile = common.materialize(train.select("text", "toxic").mapInArrow(_profile(sent), "toxic int, n long, segments array<double>, bins array<long>, counts array<long>"), "profile", rows=1000)
    hist = {r[0]: r[1] for r in profile.select(F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("x.bins").agg(F.sum("x.counts")).collect()}
    lam = extreme_lambda(hist)
    top = F.coalesce(F.array_max("segments"), F.lit(0.0))
    row = profile.where("toxic = 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-F.lit(lam) * top))).first()
    k = row[0] / row[1] if row[1] else 1.0

    def weigh(batches):
        for b in batches:
            x = [evidence(s, m, lam, k) for s, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([round(math.log1p(v) * CELL) for v in x], pa.int64())], ["toxic", "x"])

    cells = profile.select("toxic", "segments", "n").mapInArrow(weigh, "toxic int, x long").groupBy("toxic", "x").count().collect()  # 2 * rows at most
    known = labels.where("toxic is not null and doc_id is not null").where(held("doc_id") != 1).groupBy("toxic").count().collect()
    prior = {r[0]: r[1] for r in known}
    w = {t: prior.get(t, c) / c for t, c in ((0, n0), (1, n1))}
    scale = (n0 + n1) / (w[0] * n0 + w[1] * n1)
    x, y = np.array([c[1] / CELL for c in cells]), np.array([c[0] for c in cells], float)
    a, b = logistic(x, y, np.array([c[2] * w[c[0]] * scale for c in cells], float))
    return Model(own, stems, lam, k, a, b)


def _scorer(model):
    def run(batches):
        m = model.value
        lex = Lexicon(m.own, m.stems)
        for b in batches:
            k = b.schema.get_field_index("_text")
            score, passages = [], []
            for text in b.column(k).to_pylist():
                ws = WORD.finditer(text.lower()) if text else ()
                found = [(lex[x[0]], x.span()) for x in ws] if text and (m.own or m.stems) else []
                s = np.array([x for x, _ in found])
                segs = maximal_segments(s) if len(s) and s.max() > 0 else []
                x = evidence([v for v, _, _ in segs], len(s), m.lam, m.k)
                score.append(1 / (1 + math.exp(-max(-40.0, min(40.0, m.a + m.b * math.log1p(x))))))
                base = math.log(max(m.k * len(s), 1e-12))
                passages.append([{"start": found[f][1][0], "end": found[e][1][1], "score": v} for v, f, e in segs if m.lam * v - base > 3.0])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            rest = [(n, c) for i, (n, c) in enumerate(zip(b.schema.names, b.columns)) if i != k]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(score, pa.float64()), pa.array(passages, kind)], [*[n for n, _ in rest], "score", "passages"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs plus score (0 to 1) and passages: every significant toxic passage (start, end in characters of the
    lower-cased text, raw score). Without a model (no labels of both classes) all score 0. Null texts count as
    empty; an empty text has the score of a text without evidence. Columns named score, passages or _text are
    replaced; a repeated row is scored as often as it stands."""
    common.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or Model({}, {}, 1.0, 1.0, -40.0, 0.0))
    d = docs.drop("score", "passages", "_text").withColumn("_text", F.col("text").cast("string"))
    fields = [f for f in d.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "passages array<struct<start:long,end:long,score:double>>"])
    return d.mapInArrow(_scorer(sent), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit(docs, labels)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (held("doc_id") == 1).alias("held_out"), "text")
    # the text stays behind: only ids, scores and passages leave Python
    common.bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model or Model({}, {}, 1.0, 1.0, -40.0, 0.0))
    scored = d.withColumnRenamed("text", "_text").mapInArrow(_scorer(sent), "doc_id long, held_out boolean, score double, passages array<struct<start:long,end:long,score:double>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
