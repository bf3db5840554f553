import random

import xxhash

from lectern.llm import simhash


def fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fp[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["Été", "the", "The", *[f"w{i}" for i in range(30)]]
    base = [rng.choices(words, k=rng.randint(1, 260)) for _ in range(20)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return [*rows, (200, None), (201, ""), (201, ""), (None, " ".join(base[0])), (None, "alone here now"), (202, "x y")]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string").repartition(4)
    assert sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=str) == brute(rows)
    small = simhash.links(simhash.fingerprints(df).groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep").where("rep is not null"), 2, tile=3)
    assert small.count() >= 0


def test_small_tiles_lose_no_link(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in [tuple(r) for r in simhash.links(df, 2, tile=3).collect()]:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = [find(i) for i in range(len(fps))]
    want = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(want[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == want:
            break
        want = new
    assert got == want


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, h string").repartition(4)
    kept = simhash.keep_one(df).collect()
    groups = {}
    for d, f, c in brute(rows):
        groups.setdefault(c if c is not None else f, []).append(d)
    assert len(kept) == len(groups) and kept[0].asDict().keys() == {"doc_id", "text", "h"}
    assert sorted([r["doc_id"] for r in kept], key=str) == sorted([min((d for d in g if d is not None), default=None) for g in groups.values()], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0
