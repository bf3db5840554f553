"""Experiments over judged and paired cases: calibration grids, minimum covers, statistics whose units are components, a
logistic diagnostic, recall by stage, parity of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as C
from lectern.shared import batches, materialize, settings

from . import stats

# calibration

#: The grid of thresholds, topic weights, penalty of a missing abstract and least evidence, and the configuration in use.
GRID = {"high": (0.68, 0.72), "partial": (0.40, 0.45), "weak": (0.20, 0.25), "in_title": (0.10, 0.12), "in_abstract": (0.06, 0.075), "no_abstract": (0.0, 0.03), "evidence": (0, 1)}
IN_USE = {"high": 0.72, "partial": 0.45, "weak": 0.25, "in_title": 0.12, "in_abstract": 0.06, "no_abstract": 0.0, "evidence": 0}


def grid() -> list[dict]:
    """All configurations with a number and their distance from the one in use."""
    rows = [dict(zip(GRID, v)) for v in product(*GRID.values())]
    return [{"config": i, **r, "distance": round(sum(abs(r[k] - IN_USE[k]) for k in GRID), 8)} for i, r in enumerate(rows)]


def _configs() -> Column:
    kinds = {"config": "int", "evidence": "int"}
    return F.array(*[F.struct(*[F.lit(v).cast(kinds.get(k, "double")).alias(k) for k, v in c.items()]) for c in grid()])


def calibrated(rows: DataFrame, k: int = 20) -> DataFrame:
    """(config, its values, queries, returned, precision, recall, f1, mrr, lost): every configuration of the grid, in one pass over rows.

    rows: one for each candidate (query_id, doc, topics_in_title, topics_in_abstract, rest, evidence_found, has_abstract, gold, gold_total): rest is the
    sum of all components but topic and abstract. Each row carries all configurations as an array; a window ranks the k returned
    (highly and partially relevant) of a query and a configuration. Means are over queries with gold; lost is the share of found gold that is not returned.
    """
    d = rows.select("query_id", "doc", "topics_in_title", "topics_in_abstract", "rest", "evidence_found", "has_abstract", "gold", "gold_total", F.explode(_configs()).alias("c"))
    topic = F.least(F.lit(C.SIGNALS["topic"][2]), F.col("topics_in_title") * F.col("c.in_title") + F.col("topics_in_abstract") * F.col("c.in_abstract"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rest") + topic - F.when(F.col("has_abstract"), 0.0).otherwise(F.col("c.no_abstract")))) + 1e-9, 4)
    d = d.withColumn("score", score).withColumn("returned", (F.col("score") >= F.col("c.partial")) & (F.col("evidence_found") >= F.col("c.evidence")))
    place = F.row_number().over(Window.partitionBy("query_id", "c.config", "returned").orderBy(F.when(F.col("score") >= F.col("c.high"), 0).otherwise(1), F.desc("score"), "doc"))
    d = d.withColumn("place", F.when(F.col("returned"), place))
    top, good = F.col("place") <= k, F.col("gold")
    q = d.groupBy("query_id", "c").agg(F.count(F.when(top, 1)).alias("n"), F.count(F.when(top & good, 1)).alias("hit"), F.count(F.when(good, 1)).alias("found"), F.count(F.when(good & F.col("returned"), 1)).alias("kept"),
                                       F.min(F.when(top & good, F.col("place"))).alias("first"), F.max("gold_total").alias("all"), F.count(F.when(F.col("returned"), 1)).alias("returned"))
    p, r = F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0), F.col("hit") / F.col("all")
    q = q.where(F.col("all") > 0).withColumn("p", p).withColumn("r", r).withColumn("f", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    mean = lambda c: stats.settled(F.avg(c))
    out = q.groupBy("c").agg(F.count(F.lit(1)).alias("queries"), mean("returned").alias("returned"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"),
                             mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), stats.settled(F.when(F.sum("found") > 0, 1 - F.sum("kept") / F.sum("found"))).alias("lost"))
    return out.select("c.*", "queries", "returned", "precision", "recall", "f1", "mrr", "lost")


def best_config(evaluated: DataFrame) -> DataFrame:
    """The one row of highest F1, then recall, least lost gold, precision, MRR, distance from the configuration in use, number."""
    key = F.struct(-F.col("f1"), -F.col("recall"), F.coalesce("lost", F.lit(1.0)), -F.col("precision"), -F.col("mrr"), F.col("distance"), F.col("config"))
    return evaluated.groupBy().agg(*[F.min_by(c, key).alias(c) for c in evaluated.columns]).where("config is not null")


def sensitivity(evaluated: DataFrame) -> DataFrame:
    """(field, value, configurations, f1, recall, precision, returned): means over all configurations that share a value."""
    d = evaluated.select("f1", "recall", "precision", "returned", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("value")) for k in GRID])).alias("x"))
    return d.groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("configurations"), *[stats.settled(F.avg(m)).alias(m) for m in ("f1", "recall", "precision", "returned")])


# minimum cover

UNIVERSE = 12


def _cheapest(masks: list[int], requests: list[int], latency: list[float], ids: list[str]) -> dict[int, tuple]:
    """covered set -> (options, requests, latency, ids) of least cost, by adding one option after another."""
    states = {0: (0, 0, 0.0, ())}
    score = lambda s: (s[0], s[1], round(s[2], 9), s[3])
    for m, r, t, i in sorted(zip(masks, requests, latency, ids), key=lambda x: x[3]):
        for covered, s in list(states.items()):
            new = (s[0] + 1, s[1] + r, s[2] + t, (*s[3], i))
            old = states.get(covered | m)
            if old is None or score(new) < score(old):
                states[covered | m] = new
    return states


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x in b.to_pylist():
            o = x["options"]
            states = _cheapest([y["mask"] for y in o], [y["requests"] for y in o], [y["latency"] for y in o], [y["option"] for y in o])
            size = x["universe"]
            key = lambda m, size=size: (m.bit_count(), [i for i in range(size) if m >> i & 1])
            best = max(states, key=key)
            n, requests, latency, ids = states[best]
            rows.append((x["_case"], best.bit_count(), best.bit_count() == size, n, requests, latency, ids))
        names = ["_case", "covered", "complete", "n_options", "requests", "latency", "options"]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def minimum_cover(options: DataFrame, items: DataFrame, case: str = "case") -> DataFrame:
    """(case, universe, covered, complete, n_options, requests, latency, options): the cheapest options that cover all items of a case, or as many
    as can be covered, by number of options, requests, latency and names.

    options (case, option, item, requests, latency): an option's row for each item that it covers; items (case, item): the universe. Exact, by a
    table of the least cost of every covered set. Options that cover the same are one before they are gathered, so a case holds 2**12 at most; a
    universe of more items has a row with null results rather than a part of it.
    """
    order = F.dense_rank().over(Window.partitionBy(case).orderBy("item")) - 1
    numbered = items.select(case, "item").distinct().withColumn("_bit", order)
    size = numbered.groupBy(case).agg(F.count(F.lit(1)).cast("int").alias("universe"))
    small = numbered.join(size.where(F.col("universe") <= UNIVERSE).select(case), case, "left_semi")
    o = options.select(case, "option", "item", "requests", "latency").join(small, [case, "item"]).groupBy(case, "option").agg(F.bit_or(F.expr("shiftleft(1, _bit)")).alias("mask"), F.max("requests").cast("long").alias("requests"), F.max("latency").cast("double").alias("latency"))
    o = o.groupBy(case, "mask").agg(F.min(F.struct("requests", F.round("latency", 9).alias("_l"), "option", "latency")).alias("x")).select(case, "mask", "x.requests", "x.latency", "x.option")
    name = F.to_json(F.struct(F.col(case)))
    g = o.groupBy(name.alias("_case")).agg(F.collect_list(F.struct("mask", "requests", "latency", "option")).alias("options"))  # 2**12 at most
    g = g.join(size.select(name.alias("_case"), "universe"), "_case")
    solved = g.mapInArrow(_covers, "_case string, covered int, complete boolean, n_options int, requests long, latency double, options array<string>")
    d = size.withColumn("_case", name).join(solved, "_case", "left")
    none = F.col("covered").isNull() & (F.col("universe") <= UNIVERSE)  # no option covers anything
    fill = lambda c, v: F.when(none, v).otherwise(F.col(c)).alias(c)
    return d.select(case, "universe", fill("covered", F.lit(0)), fill("complete", F.lit(False)), fill("n_options", F.lit(0)), fill("requests", F.lit(0)), fill("latency", F.lit(0.0)), fill("options", F.array().cast("array<string>")))


# components


def component_test(df: DataFrame, a: str, b: str, component: str, by: list[str], rounds: int = 20_000) -> DataFrame:
    """(by, units, difference, low, high, p, method): b against a with components as units: the mean of each component's mean difference, the
    interval of resampled components, and a sign-flip test over components. Nulls are no cases."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, component).agg(F.avg(F.col(b) - F.col(a)).alias("_d"))
    d = materialize(d, "units")
    mean = d.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), stats.settled(F.avg("_d")).alias("difference"))
    low = stats.interval(d, "_d", by, component, rounds).select(*by, "low", "high")
    p = stats.permutation(d, "_d", by, component, rounds=rounds).select(*by, "p", "method")
    return mean.join(low, by).join(p, by)


def _ratios(rounds: int, seed: str):
    """A block's sums of numerators and denominators in every round, both of the same drawn components."""
    start = stats.generator(seed)

    def run(batches):
        for b in batches:
            for g, at, vs, ws, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist()):
                v = np.array(vs.values) + 1j * np.array(ws.values)  # both sums of one look-up
                size = np.array([x["n"] for x in of], np.int64)
                place = [x["_b"] for x in of].index(at)
                dealing, drawing, out = start(g), start(g, at), np.zeros(rounds, complex)
                for lo in range(0, rounds, 1024):
                    count = dealing.multinomial(size.sum(), size / size.sum(), size=min(1024, rounds - lo))[:, place]
                    out[lo:lo + len(count)] = stats.drawn_sums(v, count, drawing)
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([out.real], pa.list_(pa.float64())), pa.array([out.imag], pa.list_(pa.float64()))], ["_g", "_a", "_c"])
    return run


def ratio_interval(df: DataFrame, numerator: str, denominator: str, component: str, by: list[str], rounds: int = 20_000, seed: str = "ratio") -> DataFrame:
    """(by, cases, components, ratio, low, high): sum of numerators over sum of denominators, with a percentile interval (95 %) of whole resampled
    components. What a component's cases sum to is drawn together, so no case counts for itself; a task holds a block of components and every round's
    sums, never a row for each draw. Cases with a null, or a denominator of 0, are left out; a group of nothing else has null results."""
    ok = F.col(numerator).isNotNull() & (F.coalesce(F.col(denominator), F.lit(0)) != 0)
    d = df.select(stats.group_name(by).alias("_g"), *by, F.col(component).alias("_k"), F.when(ok, F.col(numerator)).cast("double").alias("_v"), F.when(ok, F.col(denominator)).cast("double").alias("_w"))
    units = materialize(d.groupBy("_g", *by, "_k").agg(F.sum("_v").alias("_v"), F.sum("_w").alias("_w"), F.count("_w").alias("_n")), "units")
    groups = units.groupBy("_g", *by).agg(F.sum("_n").alias("cases"), F.count(F.when(F.col("_n") > 0, 1)).alias("components"), (F.sum("_v") / F.sum("_w")).alias("_r"))
    groups = materialize(groups, "groups")
    many = groups.where("components > 0").select("_g", F.least(F.lit(256), F.ceil(F.col("components") / stats.BLOCK)).alias("_m"))
    h = F.xxhash64(F.lit(seed), "_g", F.col("_k").cast("string"))
    blocks = units.where("_n > 0").join(many, "_g").groupBy("_g", F.pmod(h, "_m").alias("_b")).agg(F.sort_array(F.collect_list(F.struct(h.alias("_h"), "_v", "_w"))).alias("_c"))  # a block
    blocks = materialize(blocks.select("_g", "_b", F.col("_c._v").alias("_vs"), F.col("_c._w").alias("_ws")), "blocks")
    of = blocks.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_b", F.size("_vs").alias("n")))).alias("_of"))  # 256 at most
    sums = stats.dealt_out(blocks.join(of, "_g").select("_g", "_b", "_vs", "_ws", "_of")).mapInArrow(_ratios(rounds, seed), "_g string, _a array<double>, _c array<double>")
    sums = sums.select("_g", F.posexplode(F.arrays_zip("_a", "_c")).alias("round", "x")).groupBy("_g", "round").agg(F.sum("x._a").alias("a"), F.sum("x._c").alias("c"))
    r = F.when(F.col("c") != 0, F.col("a") / F.col("c"))
    bounds = sums.groupBy("_g").agg(F.round(F.percentile(r, 0.025), 6).alias("low"), F.round(F.percentile(r, 0.975), 6).alias("high"))
    return groups.join(bounds, "_g", "left").select(*by, "cases", "components", stats.settled(F.col("_r")).alias("ratio"), "low", "high")


def permuted_labels(df: DataFrame, component: str, key: str, label: str, rounds: int, seed: str = "components") -> DataFrame:
    """(round, component, key, label): labels moved between components of one size, each pattern whole: in every round a component gets the labels of the one
    that stands at its place in an order by hash. How many labels are set does not change, in no size; reruns agree.

    df: one row for each case (component, key). Components of one size are ordered, once by their own hash and once for each round."""
    inside = F.row_number().over(Window.partitionBy(component).orderBy(key))
    cases = materialize(df.select(F.col(component), F.col(key), F.col(label), inside.alias("_i")), "cases")
    sizes = cases.groupBy(component).agg(F.max("_i").alias("_size"))
    h = lambda *c: F.xxhash64(F.lit(seed), *c)
    own = sizes.withColumn("_at", F.row_number().over(Window.partitionBy("_size").orderBy(h(component), component)))
    drawn = sizes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = drawn.withColumn("_at", F.row_number().over(Window.partitionBy("round", "_size").orderBy(h("round", component), component))).withColumnRenamed(component, "_donor")
    pair = drawn.join(own, ["_size", "_at"]).select("round", component, "_donor")
    donor = cases.select(F.col(component).alias("_donor"), "_i", F.col(label).alias("_label"))
    return pair.join(cases.select(component, key, "_i"), component).join(donor, ["_donor", "_i"]).select("round", component, key, F.col("_label").alias(label))


#: Cases that a block of components holds, about, and rounds that a packed row holds.
CASES, ROUNDS = 1 << 16, 64


def _patterns(labels: np.ndarray) -> np.ndarray:
    """Bits of the labels of components of one size: those that are 1, then those that are neither 1 nor 0."""
    return np.concatenate((np.packbits(labels == 1, axis=1), np.packbits((labels != 1) & (labels != 0), axis=1)), axis=1)


def _packed(batches):
    """The patterns of a block of components, and their hashes in every round, by the range of hashes that they fall into."""
    for b in batches:
        for size, parts, lo, hashes, labels in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), b.column(4)):
            ls = labels.values.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, size)
            u = hashes.values.flatten().to_numpy().reshape(len(ls), -1).T
            rounds, pattern = len(u), _patterns(ls)
            u = u.ravel()
            to = np.minimum(np.floor((u / 2.0**64 + 0.5) * parts).astype(np.int64), parts - 1)
            order = np.argsort(to, kind="stable")  # within a range, by round
            ends = np.cumsum(np.bincount(to))
            rows = []
            for k, (i, j) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                if j > i:
                    at = order[i:j]
                    rows.append((size, lo, k, np.bincount(at // len(ls), minlength=rounds).astype("<i4").tobytes(), u[at].astype("<i8").tobytes(), pattern[at % len(ls)].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r)) for r in rows], _SENT)


_SENT = pa.schema([("_size", pa.int32()), ("_lo", pa.int32()), ("_at", pa.int64()), ("_many", pa.binary()), ("_u", pa.binary()), ("_p", pa.binary())])


def _sorted(batches):
    """A range of hashes: the patterns of each round in the order of their hashes, and how many."""
    for b in batches:
        for size, lo, at, parts in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
            parts = parts.values.to_pylist()
            many = np.stack([np.frombuffer(x["_many"], "<i4") for x in parts])
            of = np.concatenate([np.repeat(np.arange(many.shape[1]), m) for m in many])
            u = np.concatenate([np.frombuffer(x["_u"], "<i8") for x in parts])
            pattern = np.concatenate([np.frombuffer(x["_p"], np.uint8) for x in parts]).reshape(len(u), -1)
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([lo], pa.int32()), pa.array([at], pa.int64()), pa.array([many.sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([pattern[np.lexsort((u, of))].tobytes()], pa.binary())], ["_size", "_lo", "_at", "_n", "_p"])


_CUT = pa.schema([("_size", pa.int32()), ("_lo", pa.int32()), ("_at", pa.int64()), ("_round", pa.list_(pa.int32())), ("_off", pa.list_(pa.int64())), ("_len", pa.list_(pa.int64())), ("_p", pa.binary())])


def _cut(batches):
    """The sorted patterns of a range, in each round cut at the ends of the blocks of components whose places they take."""
    for b in batches:
        for size, lo, counts, starts, of, raw in zip(*(b.column(i).to_pylist() for i in range(6))):
            bound = np.r_[0, np.cumsum([x["_n"] for x in of])]
            pattern = np.frombuffer(raw, np.uint8).reshape(-1, 2 * -(-size // 8))
            out, used = {}, 0
            for r, (c, at) in enumerate(zip(counts, starts)):
                while c:
                    k = int(np.searchsorted(bound, at, side="right")) - 1
                    n = int(min(c, bound[k + 1] - at))
                    x = out.setdefault(of[k]["_at"], ([], [], [], []))
                    x[0].append(r), x[1].append(int(at - bound[k])), x[2].append(n), x[3].append(pattern[used:used + n].tobytes())
                    at, c, used = at + n, c - n, used + n
            yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, (size, lo, k, *x[:3], b"".join(x[3])))) for k, x in out.items()], _CUT)


def _met(batches):
    """Sums and numbers of a block's known values under label 1 and under label 0, in every round."""
    for b in batches:
        for size, lo, pieces, values in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), b.column(3)):
            v = values.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            known = values.values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
            v = np.where(known, v, 0.0)
            out = np.zeros((ROUNDS, 4))
            for x in pieces.values.to_pylist():
                bits = np.unpackbits(np.frombuffer(x["_p"], np.uint8).reshape(-1, 2, -(-size // 8)), axis=2, count=size).astype(bool)
                used = 0
                for r, off, n in zip(x["_round"], x["_off"], x["_len"]):
                    one, rest = bits[used:used + n, 0], bits[used:used + n, 1]
                    own, has = v[off:off + n], known[off:off + n]
                    none = has & ~one & ~rest
                    out[r] += (own[one].sum(), (has & one).sum(), own[none].sum(), none.sum())
                    used += n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + ROUNDS), pa.int32()), *(pa.array(c) for c in out.T)], ["round", "_s1", "_c1", "_s0", "_c0"])


def component_permutation(df: DataFrame, component: str, key: str, label: str, value: str, rounds: int = 1000, seed: str = "components") -> DataFrame:
    """(n, labelled, difference, p, rounds): how far the mean of value differs between labels, and how often labels permuted as whole patterns of
    components give as much: p = (extreme + 1) / (rounds + 1). The permutations are those of permuted_labels.

    Components of one size stand in blocks, by hash. In every round their patterns go, as bits, to ranges of the round's hashes, are sorted there,
    and go on to the blocks whose places they take, which sum. So neither a case nor a component is a row in any round, and no task holds a whole size.
    """
    d = materialize(df.select(component, key, F.col(label).cast("int").alias(label), F.col(value).cast("double").alias(value)), "labelled")
    gap = F.abs(F.avg(F.when(F.col(label) == 1, F.col(value))) - F.avg(F.when(F.col(label) == 0, F.col(value))))
    own = d.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("labelled"), gap.alias("_own"))
    h = lambda *c: F.xxhash64(F.lit(seed), *c)
    units = d.groupBy(component).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(label).alias("l"), F.col(value).alias("v")))).alias("_c"))  # cases of a component
    units = units.select(F.size("_c").alias("_size"), h(component).alias("_h"), F.col(component).alias("_k"), F.col("_c.l").alias("_l"), F.col("_c.v").alias("_v"))
    units = materialize(units, "units")
    sizes = units.groupBy("_size").agg(F.ceil(F.count(F.lit(1)) * F.col("_size") / CASES).alias("_m"))
    at = F.least(F.col("_m") - 1, F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_m")))
    blocks = units.join(sizes, "_size").groupBy("_size", "_m", at.alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_h", "_k", "_l", "_v"))).alias("_c"))  # about CASES
    blocks = materialize(blocks.select("_size", "_m", "_at", F.size("_c").cast("long").alias("_n"), F.col("_c._k").alias("_ks"), F.flatten("_c._l").alias("_ls"), F.flatten("_c._v").alias("_vs")), "blocks")
    every = stats.dealt_out(blocks.select("_size", "_m", "_ks", "_ls", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(ROUNDS))).alias("_lo")))
    drawn = F.transform("_ks", lambda k: F.transform(F.sequence(F.col("_lo"), F.least(F.col("_lo") + ROUNDS, F.lit(rounds)) - 1), lambda r: h(r, k)))
    with settings(df.sparkSession, batches(4, 16)):
        sent = every.select("_size", "_m", "_lo", drawn, "_ls").mapInArrow(_packed, "_size int, _lo int, _at long, _many binary, _u binary, _p binary")
        gathered = sent.groupBy("_size", "_lo", "_at").agg(F.collect_list(F.struct("_many", "_u", "_p")).alias("_x"))  # ROUNDS rounds of about CASES cases
        donors = materialize(gathered.mapInArrow(_sorted, "_size int, _lo int, _at long, _n array<long>, _p binary"), "donors", rows=4)
        counts = donors.select("_size", "_lo", "_at", F.posexplode("_n").alias("r", "c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("_size", "_lo", "r").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.withColumn("s", before).groupBy("_size", "_lo", "_at").agg(F.sort_array(F.collect_list(F.struct("r", "s"))).alias("_s")).select("_size", "_lo", "_at", F.col("_s.s").alias("_s"))
        of = blocks.groupBy("_size").agg(F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_of"))  # a size's blocks
        cut = donors.join(starts, ["_size", "_lo", "_at"]).join(of, "_size").select("_size", "_lo", "_n", "_s", "_of", "_p").mapInArrow(_cut, "_size int, _lo int, _at long, _round array<int>, _off array<long>, _len array<long>, _p binary")
        pieces = cut.groupBy("_size", "_lo", "_at").agg(F.collect_list(F.struct("_round", "_off", "_len", "_p")).alias("_x"))  # ROUNDS rounds of a block
        met = pieces.join(blocks.select("_size", "_at", "_vs"), ["_size", "_at"]).select("_size", "_lo", "_x", "_vs").mapInArrow(_met, "round int, _s1 double, _c1 double, _s0 double, _c0 double")
        sums = materialize(met.where(F.col("round") < rounds).groupBy("round").agg(*[F.sum(c).alias(c) for c in ("_s1", "_c1", "_s0", "_c0")]), "sums", rows=4)
    mean = lambda i: F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}") / F.col(f"_c{i}"))
    j = sums.select(F.abs(mean(1) - mean(0)).alias("_gap")).join(F.broadcast(own))  # one row
    return j.groupBy("n", "labelled").agg(stats.settled(F.max("_own")).alias("difference"), F.round((F.count(F.when(F.col("_gap") >= F.col("_own") - 1e-9 * F.greatest(F.lit(1.0), F.col("_own")), 1)) + 1) / (F.lit(rounds) + 1), 6).alias("p"), F.count(F.lit(1)).alias("rounds"))


# logistic diagnostic

FOLDS, STEPS, RATE, PENALTY = 5, 160, 0.05, 0.01


def _gradients(weights: np.ndarray, means: np.ndarray, deviations: np.ndarray, balance: np.ndarray):
    """Sums over a task's rows of each fold's gradient: rows of a fold do not teach that fold."""
    def run(batches):
        total = np.zeros_like(weights)
        for b in batches:
            x = np.array(b.column("x").values).reshape(b.num_rows, -1)
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            for k in range(len(weights)):
                use = fold != k
                z = (x[use] - means[k]) / deviations[k]
                p = 1 / (1 + np.exp(-np.clip(weights[k, 0] + z @ weights[k, 1:], -30, 30)))
                e = (p - y[use]) * balance[k, y[use].astype(int)]
                total[k, 0] += e.sum()
                total[k, 1:] += e @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])
    return run


def _probabilities(weights: np.ndarray, means: np.ndarray, deviations: np.ndarray):
    def run(batches):
        for b in batches:
            x = np.array(b.column("x").values).reshape(b.num_rows, -1)
            k = b.column("fold").to_numpy()
            z = (x - means[k]) / deviations[k]
            p = 1 / (1 + np.exp(-np.clip(weights[k, 0] + np.einsum("ij,ij->i", z, weights[k, 1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), b.column("fold"), pa.array(p)], ["key", "y", "fold", "p"])
    return run


def logistic(df: DataFrame, key: str, label: str, features: list[str], folds: int = FOLDS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[DataFrame, np.ndarray]:
    """(key, y, fold, p) out of fold, and the coefficients of each fold (intercept first) over standardised features.

    Gradient descent with balanced classes and an L2 penalty: all folds take a step in one pass over the rows, which stay where they are; a task sends one row,
    its sums. Folds go by the SHA-256 of the key. A row with a null in key, label or a feature is left out. A fold whose training rows have one class is an error.
    """
    fold = F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    rows = df.dropna(subset=[key, label, *features]).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), fold.alias("fold"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    rows = materialize(rows, "rows")
    d = len(features)
    every = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]]
    part = {r["fold"]: r for r in rows.groupBy("fold").agg(*every).collect()}  # one row for each fold
    n = np.array([sum(r["n"] for f, r in part.items() if f != k) for k in range(folds)], float)
    pos = np.array([sum(r["pos"] for f, r in part.items() if f != k) for k in range(folds)], float)
    if not (n.all() and pos.all() and (n - pos).all()):
        raise ValueError("a fold has training rows of one class only")
    means = np.array([[sum(r[f"s{i}"] for f, r in part.items() if f != k) / n[k] for i in range(d)] for k in range(folds)])
    centre = means.mean(axis=0)
    second = {r["fold"]: r for r in rows.groupBy("fold").agg(*[F.sum(F.pow(F.get("x", F.lit(i)) - float(centre[i]), 2)).alias(f"q{i}") for i in range(d)]).collect()}
    spread = np.array([[(sum(r[f"q{i}"] for f, r in second.items() if f != k) - n[k] * (means[k, i] - centre[i]) ** 2) / max(1, n[k] - 1) for i in range(d)] for k in range(folds)])
    deviations = np.sqrt(np.maximum(spread, 0))
    deviations[deviations < 1e-12 * np.maximum(1, np.abs(means))] = 1.0
    balance = np.stack((n / (2 * (n - pos)), n / (2 * pos)), axis=1)
    weights, shrink = np.zeros((folds, d + 1)), np.r_[0.0, np.full(d, penalty)]
    for _ in range(steps):
        sums = rows.mapInArrow(_gradients(weights, means, deviations, balance), "g array<double>").collect()  # one row for each task
        g = np.array([r["g"] for r in sums]).sum(axis=0).reshape(weights.shape) if sums else 0 * weights
        weights = weights - rate * (g / n[:, None] + shrink * weights)
    return rows.mapInArrow(_probabilities(weights, means, deviations), "key " + dict(rows.dtypes)["key"] + ", y double, fold int, p double"), weights


# stages and parity


def stage_recall(gold: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, stratum, queries, gold, found, recall): how many gold documents each stage still has, for every stratum and in total (a null stratum is the
    total, `level` tells them apart), as shares of all and as the mean over queries, in one aggregate with grouping sets.

    gold (query_id, doc, stratum, gold_total, and a boolean of each stage): a query has one stratum; its rows weigh one together."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s), F.lit(False)).cast("int").alias("hit")) for s in stages]))
    d = gold.select("query_id", "stratum", "gold_total", each.alias("x")).select("query_id", "stratum", "gold_total", "x.stage", "x.hit")
    g = d.groupingSets([["stage", "stratum"], ["stage"]], "stage", "stratum")
    return g.agg(F.grouping("stratum").cast("int").alias("level"), F.count(F.lit(1)).alias("gold"), F.sum("hit").alias("found"), stats.settled(F.sum("hit") / F.count(F.lit(1))).alias("micro"), stats.settled(F.sum(F.col("hit") / F.col("gold_total")) / F.sum(1 / F.col("gold_total"))).alias("macro"))


def parity(left: DataFrame, right: DataFrame, case: str, fields: list[str]) -> DataFrame:
    """(case, n_left, n_right, only_left, only_right, same) of every case of either side: rows are compared as multisets of all their fields, so a row
    that one side has twice and the other once differs; nulls equal nulls."""
    a, b = left.select(case, *fields), right.select(case, *fields)
    count = lambda d, n: d.groupBy(case).agg(F.count(F.lit(1)).alias(n))
    every = count(a, "n_left").join(count(b, "n_right"), case, "full")
    d = every.join(count(a.exceptAll(b), "only_left"), case, "left").join(count(b.exceptAll(a), "only_right"), case, "left").fillna(0, ["n_left", "n_right", "only_left", "only_right"])
    return d.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))
