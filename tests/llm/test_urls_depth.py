"""Paths that part below the third segment, and rare segments of a large host."""

from lectern.llm import urls

RULES = (("block", "b.com", "/p/q/r/bad/"), ("allow", "b.com", "/p/q/r/good/"), ("block", "d.com", "/rare/known/"), ("allow", "d.com", "/"), ("allow", "c.net", "/x/y/z/good"), ("block", "c.net", "/x/y/z/bad"))


def judged(spark, urls_of):
    df = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string").repartition(3)
    return {r["page_id"]: r for r in urls.judge(df, RULES).collect()}


def test_branches_part_at_any_depth(spark):
    known = [f"http://b.com/p/q/r/{w}/s/{i}" for w in ("bad", "good") for i in range(40)]
    other = [f"http://a.net/p/q/r/{w}/s/{i}" for w in ("bad", "good") for i in range(40)]
    long = ["http://f.net/" + "/".join("abcdefghijklmnop"), "http://f.net", "http://f.net/"]
    out = judged(spark, known + other + long)
    assert {out[80 + i]["verdict"] for i in range(40)} == {"block"} and {out[120 + i]["verdict"] for i in range(40)} == {"allow"}
    assert out[80]["template"] == "/p/q/r/bad/s/#" and out[120]["template"] == "/p/q/r/good/s/#"
    assert [out[160 + i]["template"] for i in range(3)] == ["/" + "/".join("*" * 16), "", "/*"]


def test_a_rare_pure_section_stays_literal(spark):
    """One of a hundred pages is in a blocked section; the rules leave pages of the same section on another host open."""
    rows = [f"http://d.com/s{chr(97 + i % 20)}/x/{i}" for i in range(1980)] + [f"http://d.com/rare/known/{i}" for i in range(20)]
    out = judged(spark, rows + [f"http://e.net/rare/known/{i}" for i in range(5)])
    assert {out[1980 + i]["template"] for i in range(20)} == {"/rare/known/#"}
    assert {out[2000 + i]["verdict"] for i in range(5)} == {"block"}
