from trawler.operators import wiki

PAGE = """---
title: Mooring Lines
kind: topic
summary: "short: text"
evidence:
  - title: inner heading
---
intro
<!-- kb:section id=card -->
card text

<!-- /kb:section -->
<!-- notes:section id=core -->
core text
<!-- /notes:section -->
"""


def parsed(spark, text, rel="wiki/topics/mooring-lines.md"):
    return wiki.parse_pages(spark.createDataFrame([(rel, text)], "rel_path string, text string")).first()


def test_page(spark):
    for text in (PAGE, "﻿" + PAGE):
        p = parsed(spark, text)
        assert (p.title, p.slug, p.kind, p.summary, p.status) == ("Mooring Lines", "mooring-lines", "topic", "short: text", "")
        assert p.sections == {"card": "card text", "core": "core text"} and p.error is None
    crlf = parsed(spark, PAGE.replace("card text\n\n", "card text\r\n"))
    assert crlf.sections["card"] == "card text"


def test_page_errors(spark):
    head = "---\ntitle: x\n---\n"
    start, end = "<!-- kb:section id=card -->\n", "<!-- /kb:section -->\n"
    assert parsed(spark, "no front matter").error == "missing YAML frontmatter"
    assert parsed(spark, head + start + start + end).error == 'nested section "card"'
    assert parsed(spark, head + end).error == "unexpected section end"
    assert parsed(spark, head + start + "text").error == 'unclosed section "card"'
    assert parsed(spark, head + start + "one\n" + end + start + "two\n" + end).sections == {"card": "two"}
    assert parsed(spark, head + start + end).sections == {"card": ""}
    assert parsed(spark, head).sections == {}
    assert parsed(spark, "---\nkind: topic\n---\nbody").title == "mooring-lines"


def test_check(spark):
    rows = [
        ("wiki/topics/a.md", PAGE), ("wiki/topics/b.md", "bad"), ("wiki/index.md", "bad"), ("wiki/workflows/c.txt", "bad"),
    ]
    issues = wiki.check_documents(spark.createDataFrame(rows, "rel_path string, text string"))
    assert sorted(r.issue for r in issues.collect()) == [
        'wiki/topics/a.md: missing required section "explain"', "wiki/topics/b.md: missing YAML frontmatter",
    ]


TABLE = """# Index

| type | description | slug |
| --- | :---: | --- |
| topic | lines ashore | mooring-lines |
|  flow | a \\| b | other |

| second | table |
| x | y |
"""


def test_tables(spark):
    files = spark.createDataFrame([("wiki/index.md", TABLE)], "rel_path string, text string")
    rows = wiki.search_table(files, "index", ["ASHORE", ""]).collect()
    assert [(r.slug, r.type, r.description) for r in rows] == [("mooring-lines", "topic", "lines ashore")]
    every = wiki.search_table(files, "index", []).orderBy("row_no").collect()
    assert [(r.slug, r.description) for r in every] == [("mooring-lines", "lines ashore"), ("other", "a \\| b")]
    glossary = spark.createDataFrame(
        [("wiki/glossary.md", "| 术语 | 类型 | 说明 | slug |\n|---|---|---|---|\n| 缆绳 | topic | a thick rope | mooring-lines |\n")],
        "rel_path string, text string",
    )
    row = wiki.search_table(glossary, "glossary", ["缆"]).first()
    assert (row.slug, row.glossary, row.type) == ("mooring-lines", "缆绳", "topic")
    assert [r.term for r in wiki.glossary_terms(glossary).collect()] == ["缆绳"]
    assert wiki.search_table(spark.createDataFrame([("a", "no table")], "rel_path string, text string"), "index", []).isEmpty()


def test_long_table(spark):
    """A table of more lines than a pattern can recurse over; the second table is left alone."""
    lines = "".join(f"| t{i} | d \\| {i} | s{i} |\r\n" for i in range(20000))
    text = f"# Long\n\n| type | description | slug |\n|---|---|---|\n{lines}\n| other | x | y |\n"
    files = spark.createDataFrame([("wiki/index.md", text), ("none.md", None)], "rel_path string, text string")
    rows = wiki.search_table(files, "index", []).orderBy("row_no").collect()
    assert [(r.row_no, r.slug, r.description) for r in rows] == [(i, f"s{i}", f"d \\| {i}") for i in range(20000)]



def test_page_search(spark):
    files = spark.createDataFrame([("wiki/topics/mooring-lines.md", PAGE)], "rel_path string, text string")
    pages = wiki.pages(files, "topic")
    assert wiki.search_pages(pages, ["CARD"]).count() == 1 and wiki.search_pages(pages, ["zzz"]).isEmpty()
    assert wiki.pages(files, "workflow").isEmpty()
    assert wiki.read_section(pages, "mooring-lines").first().section == "card text"
    hits = spark.createDataFrame(
        [("topics/mooring-lines.md", "Old", 0.876), ("notes/topics/x.md", "", 0.5), ("flows/y.md", "Y", 0.4)],
        "rel_path string, title string, score double",
    )
    shown = wiki.page_hits(hits, pages, "topic").orderBy("slug").collect()
    assert [(r.slug, r.title, r.score) for r in shown] == [("mooring-lines", "Mooring Lines", 0.88), ("x", "x", 0.5)]


def test_find_pages_falls_back(spark):
    """Search results of the kind's folder, or without any a substring search, in one plan."""
    text = "---\ntitle: Tide\nslug: tide\nkind: topic\n---\n\n<!-- x:section card -->\nThe moon pulls.\n<!-- /x:section -->\n"
    files = spark.createDataFrame([("wiki/topics/tide.md", text)], "rel_path string, text string")
    parsed = wiki.pages(files, "topic")
    results = spark.createDataFrame([("wiki/topics/tide.md", "T", 0.5), ("notes/x.md", "X", 0.4)], "rel_path string, title string, score double")
    hit = wiki.find_pages(results, parsed, "topic", ["moon"]).collect()
    assert [(r.title, r.score) for r in hit] == [(parsed.first().title or "T", 0.5)]
    other = results.filter("rel_path LIKE 'notes%'")
    found = wiki.find_pages(other, parsed, "topic", ["OON PUL"]).collect()
    assert len(found) == parsed.filter("error IS NULL").count() and all(r.score is None for r in found)
    assert wiki.find_pages(other, parsed, "topic", ["nothing"]).count() == 0
