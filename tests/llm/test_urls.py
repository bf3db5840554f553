from lectern.llm import urls


def judged(spark, rows):
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string").repartition(3)
    return {(r["page_id"], r["host"], r["path"]): r for r in urls.judge(df).collect()}, df


def test_parts_and_rules(spark):
    rows = [(1, "https://A.Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/"), (5, "http://com/de/1"), (6, None),
            (7, "no scheme"), (8, "http://example.org"), (9, "http://example.org?/es/"), (10, "a://b://c/d"), (11, "http://notexample.org/es/1"), (None, "http://x.com/de/"), (1, "https://A.Example.ORG/es/1?x#y")]
    got, _ = judged(spark, rows)
    by = {k[0]: (k[1], k[2], r["rule"], r["verdict"]) for k, r in got.items()}
    assert by[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2][2:] == ("example.org/en/1", "block") and by[3][2:] == ("org/", "allow")
    assert by[4][2:] == ("com/fr/", "allow") and by[5][2:] == ("com/de/", "block") and by[None][3] == "block"
    assert by[6][:3] == ("", "", None) and by[7][:3] == ("", "", None)
    assert by[8] == ("example.org", "", None, by[8][3]) and by[9][:3] == ("example.org", "", None)
    assert by[10][:2] == ("b:", "//c/d") and by[11][2:] == ("org/", "allow")


def test_templates_generalise_and_judge(spark):
    rows = [(i, f"http://a.com/de/{i}") for i in range(40)] + [(100 + i, f"http://a.com/fr/{i}.html") for i in range(40)]
    rows += [(200 + i, f"http://b.net/de/{i}") for i in range(40)] + [(300 + i, f"http://b.net/fr/{i}.html") for i in range(40)]
    got, df = judged(spark, rows)
    out = {k[0]: r for k, r in got.items()}
    assert out[200]["template"] == "/de/#" and {out[200 + i]["verdict"] for i in range(40)} == {"block"}
    assert out[300]["template"] == "/fr/#.html" and {out[300 + i]["verdict"] for i in range(40)} == {"allow"}
    many = [(i, f"http://c.net/{chr(97 + i % 26)}{chr(97 + i // 26)}q/x") for i in range(300)]
    assert {r["template"] for r in judged(spark, many)[0].values()} == {"/*/x"}


def test_hosts_and_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    got, _ = judged(spark, [(1, "http://u.net/a"), (1, "http://u.net/a")])
    assert [r["verdict"] for r in got.values()] == ["allow"]
