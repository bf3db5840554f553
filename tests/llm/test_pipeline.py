import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lectern.llm import common, mixing, simhash, suffix, toxicity

from .test_bpe import OWN
from .test_mixing import targets
from .test_simhash import brute as group_brute
from .test_suffix import brute as cut_brute
from .test_toxicity import brute_score
from .test_toxicity import corpus as toxic_corpus

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs]
    for name, f in cp.STAGES:
        docs = common.materialize(f(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(stages[-1].columns)


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit(stages[0], common.table(spark, SF, "labels"))
    want = {r["doc_id"] for r in toxicity.score(stages[0], model).where("score < 0.7").select("doc_id").collect()}
    assert {r["doc_id"] for r in stages[1].select("doc_id").collect()} == want and len(want) < stages[0].count()


def test_one_of_each_group_stays(stages):
    want = {r[0] for r in simhash.near_duplicates(stages[1]).select("component_id").distinct().collect()}
    rows = [r["doc_id"] for r in stages[2].select("doc_id").collect()]
    assert sorted(rows) == sorted(want)


def test_repeated_passages_go(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect()]
    want = {i: (n, s) for i, n, s, _ in cut_brute(rows, suffix.LENGTH)}
    whole = dict(rows)
    got = stages[3].select("doc_id", "text", "n_chars").collect()
    assert len(got) == len(rows)
    for r in got:
        lost = len(whole[r["doc_id"]].encode()) - len(r["text"].encode())
        assert want[r["doc_id"]][0] <= lost <= want[r["doc_id"]][0] + 6 * want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])


def test_mix_and_tokens(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    got = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in copies.items() if c}
    tokens = stages[5].join(stages[4].select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d")).distinct(), "doc_id")
    assert tokens.where("d <> decoded_sha256").count() == 0 and stages[5].count() == stages[4].count()


KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_removed int, component_id int, size string, copies string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows of every odd kind, with columns named like what operators add, and a folder with labels."""
    docs, labels, _ = toxic_corpus(spark, 240, seed=8)
    folder = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{folder}/labels.parquet")
    passage = "this passage stands in several documents and is well over one hundred bytes long, so that all but the first lose it. "
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, passage + "first"), (1004, "second " + passage), (1005, passage + "\u00e9t\u00e9 third"), (1006, rows[5][1]), (1006, rows[5][1]), (None, "no id at all here"), (None, None),
             (1007, " ".join(f"w{k % 977}x" for k in range(60_000))), (1008, "zorvexa kradulon mupheti zorvexi " * 4)]
    full = [(i, t, "en", None if i is not None and i % 7 == 0 else f"s{(i or 0) % 3}", len(t or ""), "sc", "ke", 5, 6, "si", "co", "id", "nt") for i, t in rows]
    return spark.createDataFrame(full, KIND).repartition(3), folder


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table_and_clashing_columns(spark, odd, name):
    docs, folder = odd
    stage = dict(cp.STAGES)[name]
    got = stage(spark, docs.where("doc_id < 6"), folder)
    none = stage(spark, docs.limit(0), folder)
    assert none.count() == 0 and none.columns == got.columns
    kept = [c for c in ("score", "kept", "n_removed", "component_id", "size", "copies") if c in docs.columns]
    for r in got.select(*kept).collect():
        assert tuple(r) == ("sc", "ke", 5, 6, "si", "co")
    if name != "byte_bpe":
        assert got.columns == docs.columns


def test_toxicity_by_definition(spark, odd):
    docs, folder = odd
    model = toxicity.fit(docs, common.table(spark, folder, "labels"))
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000 and brute_score(model, r["text"]) < cp.TOXIC), key=str)
    got = rows_of(cp.drop_toxic(spark, docs, folder))
    assert [r for r in got if len(r[1] or "") < 20_000] == want and any(i == 1007 for i, _ in got)
    assert not any(i == 1008 for i, _ in got) and {(1000, None), (1001, ""), (None, None)} <= set(got)


def test_groups_by_definition(spark, odd):
    docs, folder = odd
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 1002]  # the brute form splits at blanks only
    rows.append((1002, ""))
    want = sorted({c for _, _, c in group_brute(rows)}, key=str)
    got = [i for i, _ in rows_of(cp.drop_near_duplicates(spark, docs, folder))]
    assert sorted(got, key=str) == want


def test_cuts_by_definition(spark, odd):
    docs, folder = odd
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {i: h for i, _, _, h in cut_brute([(r["doc_id"], r["text"]) for r in d.collect() if len(r["text"] or "") < 20_000], suffix.LENGTH)}
    got = {r["doc_id"]: r for r in cp.drop_repeated_passages(spark, d, folder).collect()}
    assert len(got) == d.count()
    for i, h in want.items():
        assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == h and got[i]["n_chars"] == len(got[i]["text"])


def test_mix_by_definition(spark, odd):
    docs, folder = odd
    rows = [(r["source"], len((r["text"] or "").split()), r["doc_id"], r["text"]) for r in docs.where("doc_id is null or doc_id <> 1007").collect()]
    sizes = {}
    for s, n, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    got = cp.mix_sources(spark, docs.where("doc_id is null or doc_id <> 1007"), folder).collect()
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 250
    assert set(rows_of(docs)) >= {(r["doc_id"], r["text"]) for r in got}
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] != 1006]
    assert max(ids.count(i) for i in set(ids)) <= 3


def test_tokens_by_definition(spark, odd):
    docs, folder = odd
    text = {}
    for i, t in rows_of(docs):
        text.setdefault(i, set()).add(t or "")
    got = cp.tokenize(spark, docs, folder).collect()
    assert len(got) == docs.count()
    for r in got:
        want = {hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in OWN.encode_ordinary(t))).hexdigest() for t in text[r["doc_id"]]}
        assert r["ids_sha256"] in want
