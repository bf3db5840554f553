"""Conversation structure repair: a fold over each conversation's turns, in Spark SQL functions only.

Windows mark the faults of every row. The rows of a conversation, gathered in order, are folded by `aggregate`
over the four states of a role grammar: nothing yet, after the system turn, after a user turn, after an assistant
turn. Each state carries a struct (cost, audit), and `least` of structs takes the cheapest edits, then the
ASCII-least. Grammar of role initials: `(s?(ua)+)?`.

Inside the fold an edit to an assistant turn has a letter of its own (J beside I, S beside R). Such a letter follows from
the letters before it and stands next to its twin in ASCII, so the order of codes is the order of audits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
#: What edits cost; CUT is what a truncated row costs that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: More than any cost.
FAR = 1 << 60
EMPTY, SYSTEM, USER, ASSISTANT = range(4)


def words(c) -> Column:
    """c, null as one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) mod 20 deals out; null role and text are one space.

    0 drops the row: role and text become null, as the conversation itself must not be lost. 1 empties the text, 2 takes its
    stops, 3 repeats the row, 4 makes it a user's.
    """
    kind = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % 20
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(words("text"), ".!?", "")).otherwise(words("text")))
    t = turns.select("conv_id", "turn", "role", "text").withColumn("kind", kind)
    return t.select("conv_id", "turn", F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(words("role")).alias("role"),
                    F.when(F.col("kind") != 0, text).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """Every row with its place in the conversation, its first fault (blank, duplicate, truncated or none), whether its turn
    is new and whether its role may not follow the one before. Rows without role and text stand apart, in place null."""
    there = F.col("role").isNotNull()
    t = turns.select("conv_id", "turn", "role", "text", there.alias("there")).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    whole = Window.partitionBy("conv_id", "there").orderBy(*order)
    initial = F.left("role", F.lit(1))
    before, turn = F.lag(initial).over(whole), F.lag("turn").over(whole)
    t = t.select("*", F.when(F.col("there"), F.row_number().over(whole)).alias("place"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(turn)).alias("new_turn"),
                 (before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")).alias("illegal"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy("place")) > 1
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return t.withColumn("seen", seen).withColumn(
        "fault", F.when(last == "", "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")).drop("there", "seen")


def _edit(state: Column, cost, letter: str) -> Column:
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["code"], F.lit(letter)).alias("code"))


def _inserted(a: list[Column]) -> list[Column]:
    """The states after any insertions: at most a user and an assistant turn, as more only lead back."""
    user = F.least(a[USER], *[_edit(a[s], INSERT, "I") for s in (EMPTY, SYSTEM, ASSISTANT)])
    return [a[EMPTY], a[SYSTEM], user, F.least(a[ASSISTANT], _edit(user, INSERT, "J"))]


def _packed(states: list[Column]) -> Column:
    return F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)])


def _step(acc: Column, row: Column) -> Column:
    far = F.struct(F.lit(FAR).alias("cost"), F.lit("").alias("code"))
    a = [acc[f"s{i}"] for i in range(4)]
    stay = F.when(row["fault"] == "truncated", CUT).otherwise(0)
    may = ~F.coalesce(row["fault"].isin("blank", "duplicate"), F.lit(False))

    def into(target: int, initial: str, sources: tuple[int, ...], letter: str | None) -> Column:
        best = F.least(*[a[s] for s in sources]) if len(sources) > 1 else a[sources[0]]
        found = [_edit(a[target], DELETE, "D"), F.when(may & (row["initial"] == initial), _edit(best, stay, "K")).otherwise(far)]
        if letter:
            found.append(F.when(may, _edit(best, stay + REROLE, letter)).otherwise(far))
        return F.least(*found)

    return _packed([_edit(a[EMPTY], DELETE, "D"), into(SYSTEM, "s", (EMPTY,), None),
                    into(USER, "u", (EMPTY, SYSTEM, ASSISTANT), "R"), into(ASSISTANT, "a", (USER,), "S")])


def _spread(states: Column) -> Column:
    """Insertions before the next row, bound once: `aggregate` evaluates an expression as often as it is named."""
    return F.transform(F.array(states), lambda s: _packed(_inserted([s[f"s{i}"] for i in range(4)])))[0]


def _repaired(turns: Column, code: Column) -> Column:
    """The turns that the code leaves: an array of (role, text)."""
    def line(role, text):
        return F.struct(role.alias("role"), text.alias("text"))

    def inserted(letters):
        return F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: line(F.when(x == "I", "user").otherwise("assistant"), F.lit("")))

    def of_row(part, i):
        edit, row = F.right(part, F.lit(1)), turns[i]
        role = F.when(edit == "R", "user").when(edit == "S", "assistant").otherwise(row["role"])
        return F.concat(inserted(F.regexp_extract(part, "^[IJ]*", 0)), F.when(edit == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(line(role, row["text"]))))

    rows = F.flatten(F.transform(F.regexp_extract_all(code, F.lit("[IJ]*[DKRS]"), F.lit(0)), of_row))
    return F.concat(rows, inserted(F.regexp_extract(code, "[IJ]*$", 0)))


def repair(turns: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text), a row for each conv_id with gaps, blank, duplicate, truncated, illegal, cost, audit and
    the repaired turns (an array of role and text).

    Rows go by turn, null turns first, then by role and text. A row whose role and text are null only keeps its
    conversation: one without other rows has zeros, an empty audit and no turns. Null conv_ids are one conversation; other nulls
    in role or text are one space. A turn whose role is empty, or begins with another letter, cannot be kept. Repeated rows are duplicates; other columns do not matter; an empty table gives no rows.
    A conversation's rows meet in one task, as they do in its result.
    """
    both = F.col("role").isNull() & F.col("text").isNull()
    t = turns.select("conv_id", "turn", F.when(~both, words("role")).alias("role"), F.when(~both, words("text")).alias("text"))
    row = F.when(F.col("place").isNotNull(), F.struct("place", "role", "text", "fault", F.left("role", F.lit(1)).alias("initial")))
    count = lambda what: F.sum(F.when(F.col("place").isNotNull() & what, 1).otherwise(0)).cast("long")
    turn = F.when(F.col("place").isNotNull(), F.col("turn"))
    g = faults(t).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), F.sort_array(F.collect_list(row)).alias("turns"))
    far = F.struct(F.lit(FAR).alias("cost"), F.lit("").alias("code"))
    start = _packed([F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("code")), far, far, far])
    end = F.aggregate("turns", _spread(start), lambda acc, r: _spread(_step(acc, r)), lambda acc: F.least(acc["s0"], acc["s3"]))
    g = g.withColumn("end", end)
    return g.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"),
                    F.translate("end.code", "JS", "IR").alias("audit"), _repaired(F.col("turns"), F.col("end.code")).alias("repaired"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repair(damage(common.table(spark, sf_dir, "conversations")))
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return r.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n").cast("binary"), 256)).drop("repaired")


#: The same rows in DuckDB: crc32 by bits, then the fold as a recursion over places, a list of four (cost, code) structs per row.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                            lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS kind FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS stop,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM hurt),
marked AS (
  SELECT *, CASE WHEN stop = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         count(*) AS n, list({'role': role, 'text': text, 'fault': fault, 'initial': initial} ORDER BY place) AS rows
  FROM marked GROUP BY conv_id),
folded AS (
  SELECT conv_id, 0 AS i, [{'cost': 0::BIGINT, 'code': ''}, {'cost': 1000000000000::BIGINT, 'code': ''}, {'cost': 5::BIGINT, 'code': 'I'}, {'cost': 10::BIGINT, 'code': 'IJ'}] AS s FROM counted
  UNION ALL
  SELECT conv_id, i + 1, [t[1], t[2], t[3], list_sort([t[4], {'cost': t[3].cost + 5, 'code': t[3].code || 'J'}])[1]]
  FROM (SELECT conv_id, i, [t[1], t[2], list_sort([t[3], {'cost': t[1].cost + 5, 'code': t[1].code || 'I'}, {'cost': t[2].cost + 5, 'code': t[2].code || 'I'},
                                                   {'cost': t[4].cost + 5, 'code': t[4].code || 'I'}])[1], t[4]] AS t
        FROM (SELECT conv_id, i, [
                {'cost': s[1].cost + 2, 'code': s[1].code || 'D'},
                list_sort([{'cost': s[2].cost + 2, 'code': s[2].code || 'D'}, {'cost': s[1].cost + keep + if(r.initial = 's', 0, far), 'code': s[1].code || 'K'}])[1],
                list_sort([{'cost': s[3].cost + 2, 'code': s[3].code || 'D'}, {'cost': u.cost + keep + if(r.initial = 'u', 0, far), 'code': u.code || 'K'},
                           {'cost': u.cost + keep + 1, 'code': u.code || 'R'}])[1],
                list_sort([{'cost': s[4].cost + 2, 'code': s[4].code || 'D'}, {'cost': s[3].cost + keep + if(r.initial = 'a', 0, far), 'code': s[3].code || 'K'},
                           {'cost': s[3].cost + keep + 1, 'code': s[3].code || 'S'}])[1]] AS t
              FROM (SELECT f.conv_id, f.i, f.s, c.rows[f.i + 1] AS r, list_sort([f.s[1], f.s[2], f.s[4]])[1] AS u, 1000000000000::BIGINT AS far,
                           CASE c.rows[f.i + 1].fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000000 END AS keep
                    FROM folded f JOIN counted c ON c.conv_id IS NOT DISTINCT FROM f.conv_id WHERE f.i < c.n)))),
ended AS (
  SELECT c.*, list_sort([f.s[1], f.s[4]])[1].cost AS cost, list_sort([f.s[1], f.s[4]])[1].code AS code
  FROM folded f JOIN counted c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.i),
parted AS (
  SELECT conv_id, code, rows, regexp_extract_all(code, '[IJ]*[DKRS]') || [regexp_extract(code, '[IJ]*$')] AS parts FROM ended),
lines AS (
  SELECT conv_id, array_to_string(list_filter(flatten(list_transform(parts, lambda p, i: list_transform(string_split(p, ''), lambda x:
           CASE x WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' WHEN 'K' THEN rows[i].role || ':' || rows[i].text
                  WHEN 'R' THEN 'user:' || rows[i].text WHEN 'S' THEN 'assistant:' || rows[i].text END))), lambda x: x IS NOT NULL), chr(10)) AS repaired
  FROM parted)
SELECT o.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated,
       coalesce(e.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, translate(coalesce(e.code, ''), 'JS', 'IR') AS audit, sha256(coalesce(l.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id"""
