"""URL filters: rules first, then a path-template tree for each host, judged by smoothed labelled purity.

DataFrame operations only. Every page that a rule decides is labelled evidence for the templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Levels of a template that every path has; a segment stays literal with 1/SHARE of its node's pages; the prior's weight;
#: Hoeffding's factor for a chance of 5 % that equal branches are kept apart; purity beyond which a template goes.
DEPTH, SHARE, PRIOR, APART, PURITY = 3, 50, 4, 1.3581, 0.5
#: Labelled pages with which a segment stays literal whatever its share.
SUPPORT = 100
SALTS = 32


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the url is null or has no '://'."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return pages.withColumn("host", common.lower_ascii(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, null without one."""
    def fits(host: str, path: str):
        h = F.col("host")
        return ((h == host) | h.endswith("." + host)) & F.col("path").startswith(path)

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        rule = F.when(fits(host, path), host + path).otherwise(rule)
        verdict = F.when(fits(host, path), v).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _salted(big: DataFrame, small: DataFrame, keys: list[str], by: tuple[str, ...] = ("sign",)) -> DataFrame:
    """A left join whose hot keys (a host may hold a third of all pages) are dealt over SALTS tasks."""
    few = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(few, [*keys, "_salt"], "left").drop("_salt")


def templates(paths: DataFrame, share: int = SHARE, support: int = SUPPORT, apart: float = APART) -> tuple[DataFrame, int]:
    """paths (host, sign, n, b, a: a path with runs of digits as one sign, its pages, labelled block, labelled
    allow) plus ts, the path's template after each level, and the number of levels.

    A segment stays literal if it is in at least two of its node's pages and in 1/share of them, or has `support`
    labelled ones, or its share of blocked differs from that of its siblings beyond Hoeffding's bound; else it
    becomes a wildcard. Levels go on until no path has another segment; below the first DEPTH a path that is alone
    in its node ends at once, with all its segments in one level.
    """
    s = F.when(F.col("sign") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("sign", 2, 1 << 30), "/", -1))
    d = common.materialize(paths.withColumn("_s", s).withColumn("ts", F.array().cast("array<string>")).withColumn("_t", F.lit("")), "templates")
    done, d, k = [d.where(F.size("_s") == 0)], d.where(F.size("_s") > 0), 0
    while not d.isEmpty():
        k += 1
        d = d.withColumn("_seg", F.get("_s", F.lit(k - 1)))
        node = d.groupBy("host", "_t").agg(F.sum("n").alias("_all"), F.sum("b").alias("_nb"), F.sum("a").alias("_na"), F.count(F.lit(1)).alias("_paths"))
        here = d.groupBy("host", "_t", "_seg").agg(F.sum("n").alias("_c"), F.sum("b").alias("_b"), F.sum("a").alias("_a")).join(node, ["host", "_t"])
        own, rest = F.col("_b") + F.col("_a"), F.col("_nb") - F.col("_b") + F.col("_na") - F.col("_a")
        gap = F.when((own > 0) & (rest > 0), F.abs(F.try_divide("_b", own) - F.try_divide(F.col("_nb") - F.col("_b"), rest)) - apart * (1 / F.sqrt(own) + 1 / F.sqrt(rest)))
        literal = (F.col("_c") >= 2) & ((F.col("_c") * share >= F.col("_all")) | (own >= support) | F.coalesce(F.round(gap, 9) > 0, F.lit(False)))
        kept = here.select("host", "_t", "_seg", literal.alias("_own"), ((F.col("_paths") == 1) & F.lit(k > DEPTH)).alias("_alone"))
        after = F.slice("_s", k, F.greatest(F.size("_s") - (k - 1), F.lit(0)))
        word = F.when(F.col("_alone"), F.array_join(F.when(F.col("n") >= 2, after).otherwise(F.transform(after, lambda x: F.lit("*"))), "/"))
        word = word.when(F.col("_own"), F.col("_seg")).otherwise("*")
        d = _salted(d, kept, ["host", "_t", "_seg"]).withColumn("_t", F.concat("_t", F.lit("/"), word)).withColumn("ts", F.concat("ts", F.array("_t")))
        d = common.materialize(d.withColumn("_end", F.col("_alone") | (F.size("_s") <= k)).drop("_seg", "_own", "_alone"), "templates")
        done.append(d.where("_end").drop("_end"))
        d = d.where("not _end").drop("_end")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("_s", "_t"), k


def last(ts: str = "ts"):
    return F.coalesce(F.get(ts, F.size(ts) - 1), F.lit(""))


def merged(leaves: DataFrame, p0: float, depth: int, prior: int = PRIOR, apart: float = APART) -> DataFrame:
    """leaves (host, ts, n, b, a: templates after each level, pages, labelled block, labelled allow) plus m (the
    merged branch) and prior (from the same template on all hosts).

    Level by level, branches of a merged node are ordered by their smoothed share of blocked pages; a branch
    joins the one before it unless the shares differ beyond Hoeffding's bound. A path that has ended keeps its
    last template.
    """
    m = leaves.withColumn("m0", F.lit(""))
    for k in range(1, depth + 1):
        t, up = "_t", f"m{k - 1}"
        at = F.coalesce(F.get("ts", F.lit(k - 1)), last())
        m = m.withColumn(t, at)
        all_hosts = leaves.groupBy(at.alias(t)).agg(F.sum("b").alias("_gb"), F.sum("a").alias("_ga"))
        branch = m.groupBy("host", up, t).agg(F.sum("b").alias("_b"), F.sum("a").alias("_a")).join(all_hosts, t)
        pg = (F.col("_gb") + prior * p0) / (F.col("_gb") + F.col("_ga") + prior)
        branch = branch.withColumn("_pg", pg).withColumn("_r", F.round((F.col("_b") + prior * F.col("_pg")) / (F.col("_b") + F.col("_a") + prior), 9))
        branch = branch.withColumn("_w", 1 / F.sqrt(F.col("_b") + F.col("_a") + F.col("_gb") + F.col("_ga") + 1))
        order = Window.partitionBy("host", up).orderBy("_r", t)  # the branches of one node: few, as literals hold a share or labelled pages
        gap = F.round(F.col("_r") - F.lag("_r").over(order) - apart * (F.col("_w") + F.lag("_w").over(order)), 9)
        branch = branch.withColumn("_new", F.coalesce(gap > 0, F.lit(False)).cast("long"))
        branch = branch.withColumn(f"m{k}", F.concat(up, F.lit("/"), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("string")))
        keep = branch.select("host", up, t, f"m{k}", *(["_pg"] if k == depth else []))
        m = common.materialize(m.join(keep, ["host", up, t]).drop(up, t), "branches")
    return m.withColumnRenamed(f"m{depth}", "m").withColumnRenamed("_pg", "prior")


def judge(pages: DataFrame, rules=RULES, depth: int = DEPTH, share: int = SHARE, prior: int = PRIOR, purity: float = PURITY) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, score (the branch's smoothed share of blocked).

    The rule's verdict holds where one fits. Elsewhere a page is blocked if its merged branch's share of
    blocked labelled pages, smoothed towards that of the same template on all hosts, is beyond `purity`. Null
    urls and those without '://' have empty host and path, and are a template of their own; repeated rows and
    null page ids stay; extra columns are ignored; without labelled pages everything is allowed; an empty
    table gives no rows. `depth` is the least number of levels, not a bound.
    """
    d = ruled(parsed(pages.select("page_id", "url")), rules).drop("url").withColumn("sign", F.regexp_replace("path", "[0-9]+", "#"))
    paths, levels = templates(d.groupBy("host", "sign").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("b"), F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("a")), share)
    leaves = common.materialize(paths.groupBy("host", "ts").agg(*[F.sum(c).alias(c) for c in ("n", "b", "a")]), "leaves")
    b, a = leaves.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    m = merged(leaves, (b + 1) / (b + a + 2), max(depth, levels), prior)
    units = m.groupBy("host", "m").agg(F.sum("b").alias("_b"), F.sum("a").alias("_a"), (F.sum(F.col("n") * F.col("prior")) / F.sum("n")).alias("_p"))
    score = F.round((F.col("_b") + prior * F.col("_p")) / (F.col("_b") + F.col("_a") + prior), 9)
    found = m.select("host", "ts", "m").join(units, ["host", "m"]).select("host", "ts", score.alias("score"))
    found = _salted(paths.select("host", "sign", "ts"), found, ["host", "ts"]).select("host", "sign", last().alias("template"), "score")
    out = _salted(d, found, ["host", "sign"], ("page_id", "path"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > purity, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def _oracle() -> str:
    def fits(host, path):
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"

    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    sql = [rf"""WITH hosts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{common.ASCII_UPPER}', '{common.ASCII_UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
d0 AS (SELECT *, {rule} AS rule, {said} AS said, '' AS t0, string_split(regexp_replace(substr(path, 2), '[0-9]+', '#', 'g'), '/') AS s FROM hosts),
e0 AS (SELECT *, CASE WHEN path = '' THEN 0 ELSE len(s) END AS n FROM d0)"""]
    for k in range(1, DEPTH + 1):
        deep = f" || CASE WHEN n > {DEPTH} THEN '/**' ELSE '' END" if k == DEPTH else ""
        sql.append(f"""c{k} AS (SELECT host, t{k - 1}, s[{k}] AS seg, count(*) AS c FROM e{k - 1} WHERE n >= {k} GROUP BY ALL),
l{k} AS (SELECT host, t{k - 1}, seg FROM (SELECT *, sum(c) OVER (PARTITION BY host, t{k - 1}) AS node FROM c{k}) WHERE c >= 2 AND c * {SHARE} >= node),
e{k} AS (SELECT e.*, CASE WHEN n >= {k} THEN e.t{k - 1} || '/' || CASE WHEN l.seg IS NOT NULL THEN l.seg ELSE '*' END{deep} ELSE e.t{k - 1} END AS t{k}
  FROM e{k - 1} e LEFT JOIN l{k} l ON e.host = l.host AND e.t{k - 1} = l.t{k - 1} AND e.s[{k}] = l.seg AND e.n >= {k})""")
    leaf = ", ".join(f"t{k}" for k in range(1, DEPTH + 1))
    sql.append(f"""leaves AS (SELECT host, {leaf}, count(*) AS n, count(*) FILTER (said = 'block') AS b, count(*) FILTER (said = 'allow') AS a, '' AS m0 FROM e{DEPTH} GROUP BY host, {leaf}),
base AS (SELECT (coalesce(sum(b), 0) + 1)::DOUBLE / (coalesce(sum(b), 0) + coalesce(sum(a), 0) + 2) AS p0 FROM leaves)""")
    last = "leaves"
    for k in range(1, DEPTH + 1):
        sql.append(f"""g{k} AS (SELECT t{k}, sum(b) AS gb, sum(a) AS ga FROM leaves GROUP BY t{k}),
b{k} AS (SELECT x.host, x.m{k - 1}, x.t{k}, sum(x.b) AS b, sum(x.a) AS a, any_value(gb) AS gb, any_value(ga) AS ga, any_value((gb + {PRIOR} * p0) / (gb + ga + {PRIOR})) AS pg
  FROM {last} x JOIN g{k} USING (t{k}), base GROUP BY ALL),
r{k} AS (SELECT *, round((b + {PRIOR} * pg) / (b + a + {PRIOR}), 9) AS r, 1 / sqrt(b + a + gb + ga + 1) AS w FROM b{k}),
o{k} AS (SELECT *, CASE WHEN round(r - lag(r) OVER x - {APART} * (w + lag(w) OVER x), 9) > 0 THEN 1 ELSE 0 END AS fresh FROM r{k} WINDOW x AS (PARTITION BY host, m{k - 1} ORDER BY r, t{k})),
k{k} AS (SELECT host, m{k - 1}, t{k}, pg AS pg{k}, m{k - 1} || '/' || CAST(CAST(sum(fresh) OVER (PARTITION BY host, m{k - 1} ORDER BY r, t{k}) AS BIGINT) AS VARCHAR) AS m{k} FROM o{k}),
m{k}x AS (SELECT * FROM {last} JOIN k{k} USING (host, m{k - 1}, t{k}))""")
        last = f"m{k}x"
    sql.append(f"""units AS (SELECT host, m{DEPTH}, sum(b) AS b, sum(a) AS a, sum(n * pg{DEPTH}) / sum(n) AS p FROM {last} GROUP BY ALL),
found AS (SELECT host, {leaf}, round((u.b + {PRIOR} * u.p) / (u.b + u.a + {PRIOR}), 9) AS score FROM {last} JOIN units u USING (host, m{DEPTH}))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score > {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, t{DEPTH} AS template
FROM e{DEPTH} JOIN found USING (host, {leaf})""")
    return ",\n".join(sql)


OP7_SQL = _oracle()
