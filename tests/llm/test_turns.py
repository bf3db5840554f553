import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def faulty(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        end = text.rstrip(SPACE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying every edit of every row, and every insertion between rows."""
    best = None
    choices = []
    for role, text, fault in rows:
        own = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            cut = 5 * (fault == "truncated")
            own += [("K", cut, [(role, text)]), *[("R", cut + 1, [(r, text)]) for r in ("user", "assistant") if r[0] != role[:1]]]
        choices.append(own)
    gaps = [("", 0, []), ("I", 5, [("user", "")]), ("I", 5, [("assistant", "")]), ("II", 10, [("user", ""), ("assistant", "")]), ("II", 10, [("assistant", ""), ("user", "")])]
    for picks in product(*choices):
        for between in product(gaps, repeat=len(rows) + 1):
            order = [x for pair in zip(between, picks) for x in pair] + [between[-1]]
            cost = sum(x[1] for x in order)
            if best and cost > best[0]:
                continue
            said = [y for x in order for y in x[2]]
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in said)):
                best = min(best or (cost, "~", []), (cost, "".join(x[0] for x in order), said))
    return best


def brute(conv):
    rows = faulty(conv)
    t = [x[0] for x in conv if x[0] is not None]
    i = [r[0][:1] for r in rows]
    cost, audit, said = cheapest(rows)
    return (max(t) - min(t) + 1 - len(set(t)) if t else 0, *[sum(r[2] == f for r in rows) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(i, i[1:])), cost, audit, said)


def repaired(spark, rows):
    out = turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return {r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], [(x["role"], x["text"]) for x in r["repaired"]]) for r in out}


def test_every_edit_tried(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randint(0, 3)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
            rows.append((c, rng.choice([t, t, None, t + 2, 0]), role, rng.choice(["Yes.", "Is it?", "and so", " ", "", "on\n", "No! ", "ß…", "Yes."])))
    got = repaired(spark, rows)
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(tuple(r))
    assert got == {c: brute(r) for c, r in convs.items()}


def test_edges(spark):
    rows = [(1, None, None, None), (2, None, "user", "Hm"), (2, None, None, "x."), (None, 3, "user", "A."), (None, 9, "assistant", "B.")]
    rows += [(4, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(3000)] + [(4, 0, "user", "turn 0.")]
    got = repaired(spark, rows)
    assert got[1] == (0, 0, 0, 0, 0, 0, "", [])
    assert got[2][:7] == (0, 0, 0, 1, 1, 4, "DD")
    assert got[None] == (5, 0, 0, 0, 0, 0, "KK", [("user", "A."), ("assistant", "B.")])
    assert got[4][:6] == (0, 0, 1, 0, 1, 2) and got[4][6] == "KD" + "K" * 2999
    assert repaired(spark, []) == {}
    odd = spark.createDataFrame([(7, 0, "user", "A.", "x", 1, 2)], SCHEMA + ", audit string, place long, kind long")
    assert [r["audit"] for r in turns.repair(odd).collect()] == ["D"]
    assert turns.damage(odd).columns == ["conv_id", "turn", "role", "text"]


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (c, t, "user" if kind == 4 else role, text)
        out += [(c, t, None, None)] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def test_damage(spark):
    rows = [(c if c % 9 else None, t if t % 7 else None, r, x) for c in range(40) for t, (r, x) in enumerate([("user", "A. b!"), (None, "c?"), ("system", None)] * 3)]
    got = [tuple(r) for r in turns.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(hurt(rows), key=str)


@pytest.mark.parametrize("nulls", [False, True])
def test_query_equals_sql(spark, tmp_path, nulls):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["system", "user", "assistant"]) if t == 0 else ["user", "assistant"][t % 2], rng.choice(["Yes.", "No", "So what?", "a" * 50 + "."]) + "\n" * rng.randint(0, 1))
            for c in range(80) for t in range(rng.randint(1, 9))]
    if nulls:
        rows += [(None, t, "user", "Null id.") for t in range(5)] + [(90, None, r, "Null turn") for r in ("user", None)] + [(91, 1, None, None)] + rows[:20]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turns.op11_turn_repair(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = db.execute(turns.OP11_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got[0].asDict())
    assert sorted([tuple(r[n] for n in names) for r in got], key=str) == sorted(cur.fetchall(), key=str)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        if not r["audit"].replace("D", ""):
            assert r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
