"""Entity resolution: identity profiles, conflict-aware pairs, clusters, merged records, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import ids
from lectern.functions.text import title_key
from lectern.shared import materialize

from .graph import components

FIELDS = tuple(ids.PREFIX)


def profiles(papers: DataFrame) -> DataFrame:
    """paper_id plus n_<field> (normalised identifiers), keys, title_key, author_keys, year.

    papers has paper_id, title, authors, year and any of the six identifier columns; missing ones are null.
    """
    col = {f: F.col(f) if f in papers.columns else F.lit(None).cast("string") for f in FIELDS}
    authors = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: title_key(a)), lambda a: a != "")))
    return papers.select("paper_id", *[ids.normalised(f, c).alias(f"n_{f}") for f, c in col.items()], ids.keys(col).alias("keys"), title_key(F.col("title")).alias("title_key"), authors.alias("author_keys"), "year")


def evidence(a: str, b: str):
    """The rule that decides a pair of profile structs: conflicting ids veto, then a shared id, then title, year and an
    author, which an S2ORC id on either side forbids."""
    of = lambda s, f: F.col(f"{s}.{f}")
    conflict = F.lit(False)
    for f in FIELDS:
        x, y = of(a, f"n_{f}"), of(b, f"n_{f}")
        conflict = conflict | F.coalesce(x != y, F.lit(False))
    shared = F.arrays_overlap(of(a, "keys"), of(b, "keys"))
    held = of(a, "n_s2orc_corpus_id").isNotNull() | of(b, "n_s2orc_corpus_id").isNotNull()
    same = (of(a, "title_key") != "") & (of(a, "title_key") == of(b, "title_key")) & (of(a, "year") == of(b, "year")) & F.arrays_overlap(of(a, "author_keys"), of(b, "author_keys"))
    return (F.when(conflict, "conflicting_stable_identifier").when(F.coalesce(shared, F.lit(False)), "shared_stable_identifier")
            .when(held, "s2orc_requires_exact_identifier").when(F.coalesce(same, F.lit(False)), "exact_title_author_year").otherwise("no_identity_evidence"))


def classes(profiled: DataFrame) -> DataFrame:
    """(paper_id, rep): papers of equal profiles have one representative, the smallest id, so that a group of
    copies is compared once. Papers without any key or title stay alone."""
    cols = [c for c in profiled.columns if c != "paper_id"]
    known = (F.size("keys") > 0) | ((F.col("title_key") != "") & F.col("year").isNotNull() & (F.size("author_keys") > 0))
    fp = F.when(known, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)).otherwise(F.concat(F.lit("own:"), F.col("paper_id").cast("string")))
    p = profiled.select("paper_id", fp.alias("fp"))
    rep = p.groupBy("fp").agg(F.min("paper_id").alias("rep"))
    return p.join(rep, "fp").select("paper_id", "rep")


def pairs(profiled: DataFrame) -> DataFrame:
    """(left, right, rule) of representatives that share a key, or title and year, left < right: each pair, as many as the square of a group. Clusters use `meetings`."""
    blocks = profiled.select("paper_id", F.explode("keys").alias("block")).unionByName(
        profiled.where((F.col("title_key") != "") & F.col("year").isNotNull()).select("paper_id", F.concat_ws(":", F.lit("t"), "title_key", F.col("year").cast("string")).alias("block")))
    met = blocks.alias("a").join(blocks.alias("b"), F.expr("a.block = b.block and a.paper_id < b.paper_id")).select(F.col("a.paper_id").alias("left"), F.col("b.paper_id").alias("right")).distinct()
    j = met.join(profiled.alias("a"), F.col("left") == F.col("a.paper_id")).join(profiled.alias("b"), F.col("right") == F.col("b.paper_id"))
    return j.select("left", "right", evidence("a", "b").alias("rule"))


def meetings(profiled: DataFrame) -> DataFrame:
    """(group, side, node): all links of `pairs`, without a row for a link. Every paper of side 0 of a group links to every paper of side 1, and
    all papers of side 2 to each other.

    Papers meet under a key, or under title, year and an author where they have no S2ORC id. Two that meet do not conflict if they agree in
    the identifier fields that both have, so under each pair of sets of known fields those that agree there are one group. A paper has a
    row for each meeting and set of known fields (64 at most) that others have there.
    """
    known = sum((F.when(F.col(f"n_{f}").isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))
    at = profiled.withColumn("known", known)
    title = F.md5(F.concat_ws(":", "title_key", F.col("year").cast("string"), "author"))
    titled = at.where((F.col("title_key") != "") & F.col("year").isNotNull() & F.col("n_s2orc_corpus_id").isNull()).withColumn("author", F.explode("author_keys"))
    values = ["known", *[f"n_{f}" for f in FIELDS]]
    here = at.select(F.col("paper_id").alias("node"), *values, F.explode("keys").alias("hub")).withColumn("hub", F.concat(F.lit("k:"), "hub"))
    here = materialize(here.unionByName(titled.select(F.col("paper_id").alias("node"), *values, F.concat(F.lit("t:"), title).alias("hub"))), "hubs")
    several = here.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.collect_set("known").alias("others")).where("n > 1")  # 64 at most
    d = here.join(several.select("hub", "others"), "hub").withColumn("other", F.explode("others"))
    both = F.array(*[F.when(F.col("known").bitwiseAND(F.col("other")).bitwiseAND(1 << i) != 0, F.col(f"n_{f}")) for i, f in enumerate(FIELDS)])
    group = F.md5(F.to_json(F.struct("hub", F.least("known", "other").alias("a"), F.greatest("known", "other").alias("b"), both.alias("v"))))
    side = F.when(F.col("known") == F.col("other"), 2).when(F.col("known") < F.col("other"), 0).otherwise(1)
    return _faced(materialize(d.select(group.alias("group"), side.alias("side"), "node"), "meetings"))


def _faced(met: DataFrame) -> DataFrame:
    """Groups that make a link: of two sides, or of two papers of side 2."""
    whole = met.groupBy("group").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b OR (a = 2 AND n > 1)")
    return materialize(met.join(whole.select("group"), "group", "left_semi"), "groups")


def _roots(met: DataFrame) -> DataFrame:
    """(node, root) of what groups connect: a group is connected, so each of its papers is tied to its smallest."""
    least = met.groupBy("group").agg(F.min("node").alias("least"))
    return components(met.join(least, "group"), "least", "node")


def guarded(profiled: DataFrame, met: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of clusters none of which has two values of one identifier field.

    Field by field, in clusters that have several values: a paper without the field takes the value of the nearest papers
    with it, step by step along the links, the least if several are as near; links between different values are
    cut, and what stays connected is a cluster. This does not depend on the order of papers. Clusters without a
    conflict are not touched. Links are those of `meetings`: a side passes its least value on to the side it faces.
    """
    ids_of = profiled.select(F.col("paper_id").alias("node"), *[f"n_{f}" for f in FIELDS])
    spread = roots.join(ids_of, "node").groupBy("root").agg(*[(F.min(f"n_{f}") != F.max(f"n_{f}")).alias(f) for f in FIELDS])
    found = spread.agg(*[F.coalesce(F.max(f), F.lit(False)).alias(f) for f in FIELDS]).first()  # cutting makes no new conflicts
    for f in FIELDS:
        if not found[f]:
            continue
        nodes = roots.join(ids_of.select("node", F.col(f"n_{f}").alias("label")), "node")
        bad = nodes.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("root")
        nodes = materialize(nodes.join(bad, "root", "left_semi"), "nodes")
        inside = materialize(met.join(nodes.select("node"), "node", "left_semi"), "inside")
        facing = F.when(F.col("side") == 2, 2).otherwise(1 - F.col("side"))
        known = nodes.where("label is not null").select("node", "label")
        free, front, steps = nodes.where("label is null").select("node"), known, [known]
        while not free.isEmpty():  # only papers that the last step labelled can label others
            sent = inside.join(front, "node").groupBy("group", facing.alias("side")).agg(F.min("label").alias("label"))
            near = inside.join(sent, ["group", "side"]).groupBy("node").agg(F.min("label").alias("label"))
            front = materialize(free.join(near, "node"), "front")
            if front.isEmpty():
                break
            steps.append(front)
            free = materialize(free.join(front, "node", "left_anti"), "free")
        nodes = nodes.drop("label").join(reduce(DataFrame.unionByName, steps), "node", "left")
        kept = inside.join(nodes.select("node", "label"), "node").select(F.md5(F.concat_ws(":", "group", F.coalesce("label", F.lit("")))).alias("group"), "side", "node")
        kept = _faced(materialize(kept, "kept"))
        met = materialize(met.join(nodes.select("node"), "node", "left_anti").unionByName(kept.select(*met.columns)), "groups")
        fresh = nodes.select("node").join(_roots(kept), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        roots = materialize(roots.join(fresh.select("node"), "node", "left_anti").select("node", "root").unionByName(fresh), "roots")
    return roots


def clusters(papers: DataFrame, guard: bool = True) -> DataFrame:
    """(paper_id, cluster): the smallest paper_id of those that equivalent pairs connect. Conflicting pairs give no link, and
    no cluster holds two values of one identifier; without `guard` it may, which `conflicts` reports."""
    p = materialize(profiles(papers), "profiles")
    own = materialize(classes(p), "classes")
    reps = materialize(p.join(own.select(F.col("rep").alias("paper_id")).distinct(), "paper_id"), "representatives")
    found = meetings(reps)
    roots = _roots(found)
    if guard:
        roots = guarded(reps, found, materialize(roots, "roots"))
    return own.join(roots, own.rep == roots.node, "left").select("paper_id", F.coalesce("root", "rep").alias("cluster"))


def conflicts(papers: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, field, values): fields with several normalised values within a cluster."""
    p = profiles(papers).join(clustered, "paper_id")
    long = p.select("cluster", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("value")) for f in FIELDS])).alias("x")).select("cluster", "x.*")
    return long.groupBy("cluster", "field").agg(F.count_distinct("value").alias("values")).where("values > 1")


def merged(papers: DataFrame, clustered: DataFrame) -> DataFrame:
    """One record per cluster. papers: paper_id (its order), title, abstract, authors, year, venue, source,
    citation_count and identifiers.

    The longer trimmed title and abstract win, strictly, so of equal ones the first; a title that begins with
    "untitled" loses; the longest author list; the first year, venue and identifier that is known; sources once each
    without regard to case; the largest citation count.
    """
    d = papers.join(clustered, "paper_id")
    pos = -F.col("paper_id")
    real = (~title_key(F.col("title")).startswith("untitled")).cast("int")
    best = lambda c, *k: F.max_by(c, F.struct(*k, pos)).alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("paper_id"))).alias(c)
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    out = [F.count(F.lit(1)).alias("members"), best("title", real, size("title")), best("abstract", size("abstract")), first("year"), first("venue"),
           F.max(F.coalesce("citation_count", F.lit(0))).alias("citation_count"), F.array_sort(F.collect_set(F.lower(F.trim("source")))).alias("sources")]
    if "authors" in papers.columns:
        out.append(best("authors", F.size("authors")))
    out += [first(f) for f in FIELDS if f in papers.columns]
    return d.groupBy("cluster").agg(*out)


def lineage(papers: DataFrame, clustered: DataFrame, record: DataFrame) -> DataFrame:
    """(cluster, field, paper_id): which member gave each merged field."""
    d = papers.join(clustered, "paper_id").alias("p").join(record.alias("m"), "cluster")
    fields = [c for c in ("title", "abstract", "year", "venue") if c in papers.columns]
    rows = d.select("cluster", "p.paper_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"p.{c}") == F.col(f"m.{c}"), F.lit(False)).alias("own")) for c in fields])).alias("x"))
    return rows.where("x.own").groupBy("cluster", "x.field").agg(F.min("paper_id").alias("paper_id"))


def unique_ranked(ranked: DataFrame, clustered: DataFrame) -> DataFrame:
    """The first of each identity in a ranking (query_id, doc, rank)."""
    j = ranked.join(clustered.withColumnRenamed("paper_id", "doc"), "doc", "left").withColumn("cluster", F.coalesce("cluster", "doc"))
    return j.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "cluster").orderBy("rank"))).where("n = 1").drop("n")
