"""Statistics of paired evaluations. Resampling draws by a hash of (seed, round, place), so reruns agree."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import materialize

#: Cases of a group that one task resamples.
BLOCK = 16384
_U = np.uint64


def draw(seed: str, *key: Column) -> Column:
    """32 bits of the MD5 of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, quartiles (linear), extremes and total."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), *[F.round(F.percentile(v, q), 6).alias(a) for a, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
                               F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.sum(v), 4).alias("total"))


def settled(c: Column, places: int = 6) -> Column:
    """Rounded, with what stands on a half pushed off it: means of decimals often do, and the order of a sum must not decide."""
    return F.round(c + 1e-9, places)


def paired(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """b against a: means, mean and median difference, deviation, dz, and how many improved, tied, regressed."""
    d = F.col(b) - F.col(a)
    sd = F.stddev_samp(d)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), settled(F.avg(a)).alias("baseline"), settled(F.avg(b)).alias("experiment"), settled(F.avg(d)).alias("difference"),
                               settled(F.percentile(d, 0.5)).alias("median_difference"), F.round(sd, 6).alias("sd"), F.round(F.when(sd > 0, F.avg(d) / sd), 6).alias("dz"),
                               F.count(F.when(d > 0, 1)).alias("improved"), F.count(F.when(d == 0, 1)).alias("tied"), F.count(F.when(d < 0, 1)).alias("regressed"))


def numbered(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds i (from 0, by key) and n to the cases of each group. Groups are evaluated query sets."""
    w = Window.partitionBy(*by)
    return df.withColumn("i", F.row_number().over(w.orderBy(key)) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def dealt_out(blocks: DataFrame) -> DataFrame:
    """Rows that are few and small but cost much, over all cores: by the size of their files they would be one task."""
    return blocks.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism)


#: Rounds that one packed row of draws holds.
ROUNDS = 256


def _dealt(rounds: int, seed: str):
    """The draws of a block of slots, packed by the block of cases that they fall into: how many of each round, and their places there."""
    head = [f"{seed}:{r}:".encode() for r in range(rounds)]

    def run(batches):
        for b in batches:
            for g, at, size, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                slots = [str(i).encode() for i in range(at * BLOCK, at * BLOCK + size)]
                for lo in range(0, rounds, ROUNDS):
                    part = head[lo:lo + ROUNDS]
                    raw = b"".join(hashlib.md5(h + s).digest()[:4] for h in part for s in slots)
                    pick = np.frombuffer(raw, ">u4").astype(np.int64) % n
                    to = pick // BLOCK
                    order = np.argsort(to, kind="stable")  # within a block, by round
                    ends = np.cumsum(np.bincount(to))
                    spot, of = (pick % BLOCK)[order].astype("<u2"), order // size
                    rows = [(k, np.bincount(of[a:z], minlength=len(part)).astype("<u4").tobytes(), spot[a:z].tobytes()) for k, (a, z) in enumerate(zip(np.r_[0, ends[:-1]], ends)) if z > a]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(rows), pa.string()), pa.array([lo] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["_g", "_lo", "_b", "_many", "_spot"])
    return run


def _drawn_sums(batches):
    """Sum and number of the known values of a block that every round draws."""
    for b in batches:
        for g, lo, packed, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            v = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
            known = values.values.is_valid().to_numpy(zero_copy_only=False)
            v = np.where(known, v, 0.0)
            total = count = 0
            for x in packed.values.to_pylist():
                many, spot = np.frombuffer(x["_many"], "<u4"), np.frombuffer(x["_spot"], "<u2")
                of = np.repeat(np.arange(len(many)), many)
                total = total + np.bincount(of, v[spot], len(many))
                count = count + np.bincount(of, known[spot], len(many)).astype(np.int64)
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.string()), pa.array(np.arange(lo, lo + n), pa.int32()), pa.array(total), pa.array(count)], ["_g", "round", "_s", "_c"])


def bootstrap(df: DataFrame, value: str, by: list[str], key: str, rounds: int = 20_000, seed: str = "boot") -> DataFrame:
    """interval with the draws of SQL. Percentile interval (95 %) of the mean over resampled cases: every round draws n cases of a group by hash.

    A block of slots makes its draws in one task and sends them packed, two bytes each, to the blocks of cases that they
    fall into; no draw is a row, and neither draws nor cases are broadcast. Groups of a null key are left out, as SQL's join does.
    """
    c = numbered(df.dropna(subset=by) if by else df, by, key).select(group_name(by).alias("_g"), *by, "i", "n", F.col(value).cast("double").alias("_v"))
    blocks = c.groupBy("_g", *by, "n", F.floor(F.col("i") / BLOCK).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("i", "_v"))).alias("_c"))  # BLOCK cases
    blocks = materialize(blocks.select("_g", *by, "n", "_b", F.col("_c._v").alias("_vs")), "blocks")
    kind = "_g string, _lo int, _b long, _many binary, _spot binary"
    packed = dealt_out(blocks.select("_g", "_b", F.size("_vs"), "n")).mapInArrow(_dealt(rounds, seed), kind)
    packed = packed.groupBy("_g", "_lo", "_b").agg(F.collect_list(F.struct("_many", "_spot")).alias("_p"))  # about BLOCK * ROUNDS draws
    met = packed.join(blocks.select("_g", "_b", "_vs").hint("shuffle_hash"), ["_g", "_b"]).select("_g", "_lo", "_p", "_vs")
    sums = met.mapInArrow(_drawn_sums, "_g string, round int, _s double, _c long").groupBy("_g", "round").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    mean = F.when(F.col("_c") > 0, F.col("_s") / F.col("_c"))
    out = sums.groupBy("_g").agg(F.round(F.percentile(mean, 0.025), 6).alias("low"), F.round(F.percentile(mean, 0.975), 6).alias("high"), F.count(F.lit(1)).alias("rounds"))
    return blocks.where("_b = 0").select("_g", *by).join(out, "_g").drop("_g")


def sign_flip(df: DataFrame, value: str, by: list[str], key: str, rounds: int = 100_000, seed: str = "flip") -> DataFrame:
    """permutation in the form of SQL, a row for each sign. Two-sided Monte-Carlo permutation test of a zero mean: p = (extreme + 1) / (rounds + 1)."""
    c = numbered(df, by, key).select(*by, "i", value)
    d = c.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    sign = F.when(F.pmod(draw(seed, F.col("round"), F.col("i")), F.lit(2)) == 0, 1).otherwise(-1)
    flipped = d.groupBy(*by, "round").agg(F.abs(F.sum(sign * F.col(value))).alias("s"))
    own = c.groupBy(*by).agg(F.abs(F.sum(value)).alias("own"))
    j = flipped.join(own, by) if by else flipped.withColumn("_", F.lit(1)).join(own.withColumn("_", F.lit(1)), "_")
    return j.groupBy(*by).agg(F.round((F.count(F.when(F.col("s") >= F.col("own") - 1e-9, 1)) + 1) / (rounds + 1), 6).alias("p"))


def group_name(by: list[str]) -> Column:
    """A group as one string that is never null, so that groups of null keys join too."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")


def _cases(df: DataFrame, value: str, by: list[str], key: str, seed: str) -> DataFrame:
    """(_g, by, _k, _v): the group, a hash of the case, its value."""
    return df.select(group_name(by).alias("_g"), *by, F.col(key).alias("_key"), F.col(value).cast("double").alias("_v")).select("_g", *by, F.xxhash64(F.lit(seed), "_g", "_key").alias("_k"), "_v")


def _blocks(cases: DataFrame, groups: DataFrame, n: str) -> DataFrame:
    """(_g, _b, _ks, _vs): the cases of a group by hash in blocks of about BLOCK, at most 256, in the order of the hash."""
    many = groups.select("_g", F.least(F.lit(256), F.ceil(F.col(n) / BLOCK)).alias("_m"))
    d = cases.join(many, "_g").groupBy("_g", F.pmod("_k", "_m").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_c"))
    return d.select("_g", "_b", F.col("_c._k").alias("_ks"), F.col("_c._v").alias("_vs"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _flipped(rounds: int):
    """A block's sum of signed values in every round: 64 rounds' signs are the bits of a hash of the case and their number."""
    def run(batches):
        for b in batches:
            for g, ks, vs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                k, v = np.array(ks.values).view(np.uint64), np.array(vs.values)
                _, first, size = np.unique(k, return_index=True, return_counts=True)
                again = np.arange(len(k)) - np.repeat(np.sort(first), size[np.argsort(first)])  # cases of one key have signs of their own
                k = _mix(k + _U(0xD6E8FEB86659FD93) * again.astype(np.uint64))
                words = -(-rounds // 64)
                out = np.zeros(64 * words)
                for lo in range(0, words, 64):
                    number = np.arange(lo + 1, min(lo + 64, words) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
                    for i in range(0, len(k), 512):
                        bits = np.unpackbits(_mix(k[i:i + 512, None] + number).view(np.uint8), axis=1)
                        out[64 * lo:64 * (lo + len(number))] += v[i:i + 512] @ bits.astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([2 * out[:rounds] - v.sum()], pa.list_(pa.float64()))], ["_g", "_s"])
    return run


def _patterns(batches):
    """The share of all sign patterns of a group's values that are as extreme as its own sum."""
    for b in batches:
        p = []
        for vs in b.column(1):
            v = np.array(vs.values)
            s = v[:1]  # the first sign stays: the other half mirrors these patterns
            for x in v[1:]:
                s = np.concatenate((s + x, s - x))
            p.append(float(np.mean(np.abs(s) >= abs(v.sum()) - 1e-9)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["_g", "p"])


def permutation(df: DataFrame, value: str, by: list[str], key: str, most: int = 20, rounds: int = 100_000, seed: str = "flip") -> DataFrame:
    """(by, p, method, evaluated, nonzero): two-sided paired sign-flip test of every group.

    Over all 2**m patterns of its m non-zero differences if m <= most, else over so many random ones, with
    p = (extreme + 1) / (rounds + 1); p is 1 if all are ties. Null differences are no pairs; a group of nothing
    else has a null p. A random sign is a bit of a hash of the seed, group, key and round.
    """
    d = _cases(df, value, by, key, seed)
    real = F.abs("_v") > 1e-12
    groups = materialize(d.groupBy("_g", *by).agg(F.count("_v").alias("n"), F.count(F.when(real, 1)).alias("nonzero"), F.abs(F.sum(F.when(real, F.col("_v")))).alias("own")), "groups")
    small, large = groups.where(F.col("nonzero").between(1, most)), groups.where(F.col("nonzero") > most)
    exact = d.where(real).join(small.select("_g"), "_g").groupBy("_g").agg(F.sort_array(F.collect_list("_v")).alias("_vs")).mapInArrow(_patterns, "_g string, p double")
    sums = _blocks(d.where(real), large, "nonzero").select("_g", "_ks", "_vs").mapInArrow(_flipped(rounds), "_g string, _s array<double>")
    sums = sums.select("_g", F.posexplode("_s").alias("round", "s")).groupBy("_g", "round").agg(F.abs(F.sum("s")).alias("s"))
    drawn = sums.join(large.select("_g", "own"), "_g").groupBy("_g").agg(((F.count(F.when(F.col("s") >= F.col("own") - 1e-9, 1)) + 1) / (rounds + 1)).alias("p"))
    kind = F.when(F.col("n") == 0, "no_evaluable_pairs").when(F.col("nonzero") == 0, "exact_all_ties").when(F.col("nonzero") <= most, "exact_sign_flip").otherwise("monte_carlo_sign_flip")
    done = F.when(F.col("n") == 0, 0).when(F.col("nonzero") <= most, F.pow(F.lit(2), "nonzero")).otherwise(rounds).cast("long")
    p = F.when((F.col("n") > 0) & (F.col("nonzero") == 0), 1.0).otherwise(F.round("p", 6))
    return groups.join(exact.unionByName(drawn), "_g", "left").select(*by, p.alias("p"), kind.alias("method"), done.alias("evaluated"), "nonzero")


def exact_sign_flip(df: DataFrame, value: str, by: list[str], key: str, most: int = 20) -> DataFrame:
    """(by, p) of permutation: every group has a row, exact up to `most` non-zero differences."""
    return permutation(df, value, by, key, most).select(*by, "p")


def generator(seed: str):
    """Makes the random generator of a key: the same in every run."""
    def start(*key) -> np.random.Generator:
        return np.random.default_rng(list(hashlib.sha256(repr((seed, *key)).encode()).digest()))
    return start


#: Values of a block that are drawn in pairs: any two of them have one number of 16 bits.
CELL = 255


def drawn_sums(values: np.ndarray, many: np.ndarray, drawing: np.random.Generator) -> np.ndarray:
    """Sums of so many draws with replacement from values (all equally likely), one for each number in `many`.

    A multinomial draw deals the draws to cells of CELL values. Two independent draws in a cell are one draw from its table of the
    sums of all ordered pairs, so half the numbers and look-ups do; an odd draw is made by itself.
    """
    out = np.zeros(len(many), values.dtype)
    first = np.arange(0, len(values), CELL)
    size = np.diff(np.append(first, len(values)))
    for a, n, own in zip(first, size, drawing.multinomial(many, size / len(values)).T):
        x = values[a:a + n]
        table, two = (x[:, None] + x[None, :]).ravel(), own >> 1
        some, odd = np.flatnonzero(two), np.flatnonzero(own & 1)
        if len(some):
            ends = np.cumsum(two[some])
            out[some] += np.add.reduceat(table.take(drawing.integers(0, n * n, ends[-1], dtype=np.uint16)), np.append(0, ends[:-1]))
        out[odd] += x[drawing.integers(0, n, len(odd))]
    return out


def _resampled(rounds: int, seed: str):
    """A block's sum of drawn values in every round. How many of a round's n draws fall into each block is one multinomial
    draw of the group, which all its blocks repeat; so blocks need not meet before their sums do."""
    start = generator(seed)

    def run(batches):
        for b in batches:
            for g, at, vs, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                v = np.array(vs.values)
                size = np.array([x["n"] for x in of], np.int64)
                place = [x["_b"] for x in of].index(at)
                dealing, drawing, out = start(g), start(g, at), np.zeros(rounds)
                for lo in range(0, rounds, 1024):
                    count = dealing.multinomial(size.sum(), size / size.sum(), size=min(1024, rounds - lo))[:, place]
                    out[lo:lo + len(count)] = drawn_sums(v, count, drawing)
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([out], pa.list_(pa.float64()))], ["_g", "_s"])
    return run


def interval(df: DataFrame, value: str, by: list[str], key: str, rounds: int = 20_000, seed: str = "boot") -> DataFrame:
    """(by, n, low, high, rounds): percentile interval (95 %) of every group's mean over resampled cases.

    Null values are no cases; a group of nothing else has null bounds.
    """
    d = _cases(df, value, by, key, seed)
    groups = materialize(d.groupBy("_g", *by).agg(F.count("_v").alias("n")), "groups")
    blocks = materialize(_blocks(d.where(F.col("_v").isNotNull()), groups.where("n > 0"), "n").select("_g", "_b", "_vs"), "blocks")
    of = blocks.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_b", F.size("_vs").alias("n")))).alias("_of"))  # 256 at most
    sums = dealt_out(blocks.join(of, "_g").select("_g", "_b", "_vs", "_of")).mapInArrow(_resampled(rounds, seed), "_g string, _s array<double>")
    sums = sums.select("_g", F.posexplode("_s").alias("round", "s")).groupBy("_g", "round").agg(F.sum("s").alias("s")).join(groups.select("_g", "n"), "_g")
    mean = F.col("s") / F.col("n")
    bounds = sums.groupBy("_g").agg(F.round(F.percentile(mean, 0.025), 6).alias("low"), F.round(F.percentile(mean, 0.975), 6).alias("high"))
    return groups.join(bounds, "_g", "left").select(*by, "n", "low", "high", F.lit(rounds).alias("rounds"))


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Holm's adjusted p values (running maximum of (m - i) p) and rejections. The tests of one family."""
    order = Window.orderBy(p, key)
    d = df.withColumn("i", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    d = d.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.max((F.col("m") - F.col("i") + 1) * F.col(p)).over(order.rowsBetween(Window.unboundedPreceding, 0))), 6))
    return d.withColumn("rejected", F.col("adjusted") <= alpha).drop("i", "m")


def ks_distance(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Largest distance of the distribution functions of the two groups (group is 0 or 1). Values are counted
    before they are ordered."""
    c = df.groupBy(*by, value).agg(F.count(F.when(F.col(group) == 0, 1)).alias("a"), F.count(F.when(F.col(group) == 1, 1)).alias("b"))
    w = Window.partitionBy(*by)
    run = w.orderBy(value)
    d = F.abs(F.sum("a").over(run) / F.sum("a").over(w) - F.sum("b").over(run) / F.sum("b").over(w))
    return c.withColumn("d", d).groupBy(*by).agg(F.round(F.max("d"), 6).alias("ks"))


def standardized_difference(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    a, b = F.when(F.col(group) == 0, F.col(value)), F.when(F.col(group) == 1, F.col(value))
    sd = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return df.groupBy(*by).agg(F.round(F.when(sd > 0, (F.avg(b) - F.avg(a)) / sd), 6).alias("smd"))


def js_distance(df: DataFrame, label: str, group: str) -> DataFrame:
    """Square root of the base-2 Jensen-Shannon divergence of a label's shares in two groups."""
    c = df.groupBy(label).agg(F.count(F.when(F.col(group) == 0, 1)).alias("a"), F.count(F.when(F.col(group) == 1, 1)).alias("b"))
    every = Window.partitionBy()  # one row for each label
    c = c.withColumn("p", F.col("a") / F.sum("a").over(every)).withColumn("q", F.col("b") / F.sum("b").over(every))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return c.agg(F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(term(F.col("p")) + term(F.col("q"))) / 2)), 6).alias("js"))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Rank-sum AUC, ties at their mean rank. Scores are counted before they are ordered."""
    c = df.groupBy(*by, score).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("u", F.col("pos") * (below + F.col("neg") / 2))
    return c.groupBy(*by).agg(F.round(F.sum("u") / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two annotators: (n, agreement, kappa)."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("all"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = c.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("r")), c.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "k", "left").agg(F.sum(F.col("r") * F.coalesce("c", F.lit(0))).alias("rc"))
    j = total.withColumn("_", F.lit(1)).join(chance.withColumn("_", F.lit(1)), "_")
    po, pe = F.col("same") / F.col("all"), F.col("rc") / (F.col("all") * F.col("all"))
    return j.select(F.col("all").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"))


def concentration(df: DataFrame, by: str) -> DataFrame:
    """(groups, n, ess, herfindahl) of group sizes: the effective number is (sum n)^2 / sum n^2."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.round(F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n")), 6).alias("ess"),
                 F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("herfindahl"))


def micro(pred: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """(tp, fp, fn) of two sets of keys."""
    j = pred.select(*key).distinct().withColumn("p", F.lit(1)).join(gold.select(*key).distinct().withColumn("g", F.lit(1)), key, "full_outer")
    return j.agg(F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))


def clustered(df: DataFrame, a: str, b: str, component: str, by: list[str]) -> DataFrame:
    """Paired statistics whose units are components: the mean of a and of b in each, every component of one weight."""
    return paired(df.groupBy(*by, component).agg(F.avg(a).alias(a), F.avg(b).alias(b)), a, b, by)


def power(sd: Column, lift: float, alpha: float = 0.05, target: float = 0.8, future: int = 1000) -> Column:
    """struct(available, required, power): pairs needed to find a difference of `lift` with the target power, and the power that
    `future` pairs have, by the normal approximation. Without a spread nothing can be said."""
    z = NormalDist()
    za, zp = z.inv_cdf(1 - alpha / 2), z.inv_cdf(target)
    known = F.coalesce(sd > 0, F.lit(False))
    shift = F.when(known, lift * math.sqrt(future) / sd)

    @F.pandas_udf("double")
    def tails(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 1 - z.cdf(za - v) + z.cdf(-za - v), na_action="ignore")

    return F.struct(known.alias("available"), F.when(known, F.greatest(F.lit(2).cast("long"), F.ceil(F.pow((za + zp) * sd / lift, 2)))).alias("required"), tails(shift).alias("power"))
