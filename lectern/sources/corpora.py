"""Readers and writers of corpora: alias coalescing, latest revisions, benchmark directories, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import let, year_of


def path_value(json: Column, path: str) -> Column:
    """The trimmed string at a dotted path of a JSON text, null if empty."""
    return F.nullif(F.trim(F.get_json_object(json, "$." + path)), F.lit(""))


def parse_list(x: Column) -> Column:
    """A JSON array or a comma-separated string to distinct trimmed values in order."""
    a = F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "array<string>"), F.split(x, ","))
    return F.array_distinct(F.filter(F.transform(a, lambda v: F.trim(v)), lambda v: v != ""))


#: Names under which sources give a field.
ALIASES = {"id": ("_id", "id", "arxiv_id", "paper_id"), "title": ("title", "Title", "name"), "abstract": ("abstract", "summary", "text"), "authors": ("authors", "author"), "year": ("year", "date", "update_date", "published"), "venue": ("venue", "journal-ref", "journal")}


def read_records(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """Raw records, one JSON object a row in `value`: JSON lines, or maps of id to object or title."""
    lines = spark.read.text(path, wholetext=fmt == "map")
    if fmt != "map":
        return lines.where(F.trim("value") != "")
    m = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    body = F.when(F.get_json_object("v", "$").startswith("{"), F.col("v")).otherwise(F.to_json(F.struct(F.col("v").alias("title"))))
    return m.select(F.concat(F.lit('{"_id":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.when(body == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(body, 2, 1 << 30)))).alias("value"))


def normalise_records(raw: DataFrame) -> DataFrame:
    """id, title, abstract, authors, year, venue and why a record is skipped (null: it is not)."""
    get = lambda f: F.coalesce(*[path_value(F.col("value"), f"['{a}']" if "-" in a else a) for a in ALIASES[f]])
    d = raw.select(get("id").alias("id"), get("title").alias("title"), F.coalesce(get("abstract"), F.lit("")).alias("abstract"), parse_list(get("authors")).alias("authors"), year_of(get("year")).alias("year"), get("venue").alias("venue"), "value")
    skip = F.when(F.col("id").isNull(), "missing_id").when(F.col("title").isNull(), "missing_title")
    return d.withColumn("skipped", skip).drop("value")


def convert(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, report): the first record of each id by its content, and how many were skipped and why."""
    n = normalise_records(raw)
    place = F.row_number().over(Window.partitionBy("id").orderBy("title", "abstract"))
    numbered = n.where("skipped is null").withColumn("n", place)
    report = n.where("skipped is not null").groupBy("skipped").count().unionByName(numbered.where("n > 1").agg(F.lit("repeated_id").alias("skipped"), F.count(F.lit(1)).alias("count")))
    return numbered.where("n = 1").drop("n", "skipped"), report


def latest(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last revision of each key. Equal orders go to the larger `tie`."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def revision_conflicts(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n): keys whose last order is shared by differing rows."""
    top = df.groupBy(key).agg(F.max(order).alias("_top"))
    d = df.join(top, key).where(F.col(order) == F.col("_top"))
    return d.groupBy(key).agg(F.count_distinct(F.struct(*df.columns)).alias("n")).where("n > 1")


def conflicting_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n): ids with several different rows, which an index refuses."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*[c for c in df.columns if c != key])).alias("n")).where("n > 1")


BEIR_DOC = T.StructType([T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, queries, gold) of a benchmark directory: corpus.jsonl, queries.jsonl, qrels/test.tsv."""
    docs = spark.read.schema(BEIR_DOC).json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc"), "title", "text")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    gold = spark.read.csv(f"{folder}/qrels/test.tsv", sep="\t", header=True, schema="query_id string, doc string, grade int")
    return docs, queries, gold


def unmapped(docs: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """(kind, n): judgements without their query, without their document, queries without judgements."""
    a = gold.join(queries, "query_id", "left_anti").agg(F.lit("without_query").alias("kind"), F.count(F.lit(1)).alias("n"))
    b = gold.join(docs, "doc", "left_anti").agg(F.lit("without_document").alias("kind"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).unionByName(queries.join(gold, "query_id", "left_anti").agg(F.lit("without_judgement").alias("kind"), F.count(F.lit(1)).alias("n")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their answers: (query_id, text, title, arxiv_id), a row for each answer."""
    d = spark.read.schema("qid string, question string, answer array<string>, answer_arxiv_id array<string>").json(path)
    return d.select(F.col("qid").alias("query_id"), F.col("question").alias("text"), F.explode_outer(F.arrays_zip("answer", "answer_arxiv_id")).alias("a")).select("query_id", "text", F.col("a.answer").alias("title"), F.col("a.answer_arxiv_id").alias("arxiv_id"))


def snapshot_key(*parts: Column) -> Column:
    """A content address: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def write_snapshots(entries: DataFrame, path: str) -> DataFrame:
    """Appends entries (key, content) whose key is new; returns those that conflict with what is stored."""
    spark = entries.sparkSession
    e = entries.select("key", "content", F.sha2("content", 256).alias("digest"))
    try:
        old = spark.read.schema("key string, content string, digest string").parquet(path)
        old.take(1)
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        e.dropDuplicates(["key"]).write.parquet(path)
        return e.limit(0)
    clash = e.alias("e").join(old.alias("o"), "key").where("e.digest <> o.digest").select("key", "e.content", "e.digest")
    fresh = e.join(old, "key", "left_anti").dropDuplicates(["key"])
    fresh.write.mode("append").parquet(path)
    return clash


def replay(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests (query_id, key) with what was recorded; status is hit, corrupt (its hash does not fit) or missing."""
    j = requests.join(snapshots, "key", "left")
    return j.withColumn("status", F.when(F.col("digest").isNull(), "missing").when(F.sha2("content", 256) != F.col("digest"), "corrupt").otherwise("hit"))


def inverted(tokens: Column) -> Column:
    """A map of words to their positions from 0, made in the row: sorted pairs are cut where the word changes."""
    pairs = F.array_sort(F.transform(tokens, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))

    def entries(x):
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["w"] != F.get(x, i - 1)["w"]))
        return let(first, lambda f: F.transform(f, lambda a, k: F.struct(F.get(x, a)["w"].alias("w"), F.transform(F.slice(x, a + 1, F.coalesce(F.get(f, k + 1), F.size(x)) - a), lambda e: e["p"]).alias("ps"))))

    return F.when(F.size(tokens) > 0, F.map_from_entries(let(pairs, entries)))


def inverted_abstract(index: Column) -> Column:
    """Text of an abstract that is given as a map of words to positions: by position, then word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, paragraph, start, end, sha256): parts between blank lines with their character offsets."""
    parts = F.split(F.col(text), "\n\n+")
    gaps = F.regexp_extract_all(F.col(text), F.lit("(\n\n+)"), F.lit(1))
    before = lambda i: F.aggregate(F.slice("_p", 1, i), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("_g", 1, i), F.lit(0), lambda s, x: s + F.length(x))
    d = docs.select(key, parts.alias("_p"), gaps.alias("_g")).withColumn("_s", F.transform("_p", lambda x, i: before(i)))
    d = d.select(key, F.posexplode(F.arrays_zip("_p", "_s")).alias("index", "x"))
    return d.select(key, "index", F.col("x._p").alias("paragraph"), F.col("x._s").alias("start"), (F.col("x._s") + F.length("x._p")).alias("end"), F.sha2("x._p", 256).alias("sha256"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with sorted keys, ordered within range partitions, so that reruns write the same lines."""
    cols = sorted(df.columns)
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)
