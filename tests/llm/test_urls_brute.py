"""The whole method in plain Python, over random trees of paths with rare, deep and one-sided sections."""

import random
import re
from collections import Counter, defaultdict
from math import sqrt

import pytest

from lectern.llm import urls

RULES = (("block", "one.com", "/bad/"), ("allow", "one.com", "/"), ("block", "two.net", "/a/b/c/d/no"), ("allow", "two.net", "/a/b/c/d/yes"), ("allow", "three.org", "/x/"), ("block", "three.org", "/y/"))


def brute(rows, rules, share=50, prior=4, apart=1.3581, purity=0.5, support=100, depth=3):
    pages, paths = [], defaultdict(lambda: [0, 0, 0])
    for i, url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, said, rule = max(fits, default=(0, None, None))
        sign = re.sub("[0-9]+", "#", path)
        pages.append((i, host, path, sign, rule, said))
        c = paths[host, sign]
        c[0] += 1
        c[1] += said == "block"
        c[2] += said == "allow"
    ts = {k: [] for k in paths}
    alive = {k: k[1][1:].split("/") for k in paths if k[1]}
    level = 0
    while alive:
        level += 1
        node, child = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0])
        at = {k: (k[0], ts[k][-1] if ts[k] else "") for k in alive}
        for k, s in alive.items():
            for j in range(3):
                node[at[k]][j] += paths[k][j]
                child[at[k], s[level - 1]][j] += paths[k][j]
            node[at[k]][3] += 1
        after = {}
        for k, s in alive.items():
            (n, nb, na, count), (c, b, a) = node[at[k]], child[at[k], s[level - 1]]
            own, rest = b + a, nb - b + na - a
            differs = own > 0 and rest > 0 and round(abs(b / own - (nb - b) / rest) - apart * (1 / sqrt(own) + 1 / sqrt(rest)), 9) > 0
            literal = c >= 2 and (c * share >= n or own >= support or differs)
            alone = count == 1 and level > depth
            left = s[level - 1:]
            word = "/".join(left if paths[k][0] >= 2 else ["*"] * len(left)) if alone else s[level - 1] if literal else "*"
            ts[k].append(at[k][1] + "/" + word)
            if not alone and len(s) > level:
                after[k] = s
        alive = after
    leaves = defaultdict(lambda: [0, 0, 0])
    for k, c in paths.items():
        for j in range(3):
            leaves[k[0], tuple(ts[k])][j] += c[j]
    b0, a0 = sum(c[1] for c in leaves.values()), sum(c[2] for c in leaves.values())
    p0 = (b0 + 1) / (b0 + a0 + 2)
    merged, pg = dict.fromkeys(leaves, ""), {}
    for k in range(1, max(depth, level) + 1):
        at = {x: x[1][k - 1] if len(x[1]) >= k else x[1][-1] if x[1] else "" for x in leaves}
        every, branch = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for x, c in leaves.items():
            for j in (0, 1):
                every[at[x]][j] += c[j + 1]
                branch[x[0], merged[x], at[x]][j] += c[j + 1]
        pg = {t: (b + prior * p0) / (b + a + prior) for t, (b, a) in every.items()}
        nodes = defaultdict(list)
        for (host, up, t), (b, a) in branch.items():
            nodes[host, up].append((round((b + prior * pg[t]) / (b + a + prior), 9), t, 1 / sqrt(b + a + sum(every[t]) + 1)))
        group = {}
        for (host, up), bs in nodes.items():
            g, before = 0, None
            for r, t, w in sorted(bs):
                if before and round(r - before[0] - apart * (w + before[1]), 9) > 0:
                    g += 1
                before = (r, w)
                group[host, up, t] = f"{up}/{g}"
        merged = {x: group[x[0], merged[x], at[x]] for x in leaves}
        last = at
    units = defaultdict(lambda: [0, 0, 0.0, 0])
    for x, c in leaves.items():
        u = units[x[0], merged[x]]
        u[0] += c[1]
        u[1] += c[2]
        u[2] += c[0] * pg[last[x]]
        u[3] += c[0]
    out = []
    for i, host, path, sign, rule, said in pages:
        t = tuple(ts[host, sign])
        b, a, p, n = units[host, merged[host, t]]
        score = round((b + prior * p / n) / (b + a + prior), 9)
        out.append((i, host, path, rule, said or ("block" if score > purity else "allow"), t[-1] if t else ""))
    return sorted(out, key=str)


def tree(rng, n):
    rows = []
    for i in range(n):
        host = rng.choice(["one.com", "one.com", "two.net", "sub.two.net", "three.org", "other.io", "else.io"])
        first = rng.choice(["bad", "x", "y", "a", f"s{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}", "news"])
        rest = [rng.choice(["b", "c", "d", "no", "yes", "p", f"{rng.randint(0, 9)}", rng.choice("qrstuvw") * 2]) for _ in range(rng.randint(0, 5))]
        if host.endswith("two.net") and rng.random() < 0.5:
            first, rest = "a", ["b", "c", "d", rng.choice(["no", "yes", "maybe"]), f"{i}"]
        rows.append(f"http{rng.choice(['', 's'])}://{host}/" + "/".join([first, *rest]) + rng.choice(["", "", "/", "?q=/z", "#f"]))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    found = tree(rng, 2500)
    # a section of 130 labelled pages among more than 50 times as many, and a rare one of one sign
    found += [f"http://one.com/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26 % 26]}/t" for i in range(7000)] + [f"http://one.com/bad/{i}" for i in range(30)] + [f"http://one.com/kept/{i}" for i in range(130)]
    found += ["http://deep.io/" + "/".join("abcdefghij"[:k]) for k in range(10)] + ["http://deep.io/" + "/".join("zyxwvu")] * 3 + [None, "", "no url", "HTTP://One.COM", "x://", "http://one.com"]
    rows = list(enumerate(found)) + [(None, found[0]), (5, found[5])]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3), RULES)
    got = sorted([tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict", "template").collect()], key=str)
    assert got == brute(rows, RULES)
