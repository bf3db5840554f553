from lectern.sources import parsers


def test_nulls_and_what_cannot_be_parsed(spark):
    d = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"title": " A  b ", "authors": null, "externalIds": null, "citationCount": -4}'), (4, "{}")], "id int, j string")
    for f, source in ((parsers.works, "openalex"), (parsers.papers, "semantic_scholar")):
        rows = {r["id"]: r for r in f(d, "j", ["id"]).collect()}
        assert len(rows) == 4
        for i in (1, 2, 4):
            r = rows[i]
            assert (r["title"], r["authors"], r["abstract"], r["year"], r["doi"], r["citation_count"], r["source"]) == ("Untitled", [], "", None, None, 0, source)
    assert rows[3]["title"] == "A b" and rows[3]["citation_count"] == 0


def test_xml(spark):
    d = spark.createDataFrame([(1, None), (2, "<entry><id>http://arxiv.org/abs/2001.00001v3</id><title>T</title><author><name> A  B </name></author><updated>2020-05-06</updated></entry>"), (3, "<entry></entry>")], "id int, x string")
    rows = {r["id"]: r for r in parsers.entries(d, "x", ["id"]).collect()}
    assert (rows[2]["arxiv_id"], rows[2]["authors"], rows[2]["year"], rows[2]["venue"]) == ("2001.00001", ["A B"], 2020, "arXiv")
    assert rows[1]["title"] == rows[3]["title"] == "Untitled" and rows[1]["authors"] == rows[3]["authors"] == []
    a = spark.createDataFrame([(1, None), (2, "<A><MedlineCitation><PMID>7</PMID><Article><AuthorList><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation></A>")], "id int, x string")
    rows = {r["id"]: r for r in parsers.articles(a, "x", ["id"]).collect()}
    assert rows[2]["authors"] == ["Group"] and rows[2]["pubmed_id"] == "7" and rows[1]["title"] == "Untitled" and rows[1]["authors"] == []


def test_malformed_xml_is_a_row_with_an_error(spark):
    d = spark.createDataFrame([(1, "<entry>"), (2, "plain"), (3, "<entry><title>T</title></entry>"), (4, "")], "id int, x string")
    for f in (parsers.entries, parsers.articles):
        rows = {r["id"]: r for r in f(d, "x", ["id"]).collect()}
        assert len(rows) == 4 and rows[3]["error"] is None
        for i in (1, 2, 4):
            assert rows[i]["error"] and rows[i]["title"] == "Untitled" and rows[i]["authors"] == [] and rows[i]["year"] is None


def test_articles_keep_authors_whole_and_nested_text(spark):
    people = "".join(f"<Author>{a}</Author>" for a in (
        "<LastName>Solo</LastName>", "<LastName>Doe</LastName><ForeName>Jane</ForeName><Initials>J</Initials>", "<CollectiveName>The <i>Group</i></CollectiveName>",
        "<LastName>Ray</LastName><Initials>B</Initials>", "<ForeName>Nobody</ForeName>", "<LastName> </LastName>"))
    text = "<AbstractText>a <sup>2</sup> b</AbstractText><AbstractText Label='X'> \n </AbstractText><AbstractText>end</AbstractText>"
    date = "<JournalIssue><PubDate><Year>n.d.</Year><MedlineDate>2001 Jan-Feb</MedlineDate></PubDate></JournalIssue>"
    xml = f"<A><MedlineCitation><PMID> 7 </PMID><Article><Journal><Title/><ISOAbbreviation>J. X</ISOAbbreviation>{date}</Journal><ArticleTitle>On <i>E. coli</i> growth</ArticleTitle><Abstract>{text}</Abstract><AuthorList>{people}</AuthorList><ELocationID EIdType='DOI'>10.1/A</ELocationID></Article></MedlineCitation></A>"
    r = parsers.articles(spark.createDataFrame([(xml,)], "x string"), "x", []).first()
    assert r["authors"] == ["Solo", "Jane Doe", "The Group", "B Ray"]
    assert (r["title"], r["abstract"], r["year"], r["venue"], r["doi"], r["pubmed_id"], r["error"]) == ("On E. coli growth", "a 2 b end", 2001, "J. X", "10.1/a", "7", None)
