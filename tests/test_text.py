"""Text expressions and chunking on small cases."""

import pytest
from pyspark.sql import functions as F

from rulespan.functions import text
from rulespan.operators import chunks


def value(spark, made, given):
    return spark.createDataFrame([(given,)], "x string").select(made(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, want", [
    ("a ```python\nx = 1\n``` b ```y```", "x = 1"),
    ("```\nx\n\n  y\n```", "x\n\n  y"),
    ("  no fence ", "  no fence "),
    ("``` open", "``` open"),
])
def test_first_code_block(spark, given, want):
    assert value(spark, text.first_code_block, given) == want


@pytest.mark.parametrize("given, want", [
    ('```json\n[1]\n```', "[1]"),
    ('so {"a": [1]} and {"b": 2} end', '{"a": [1]} and {"b": 2}'),
    ("so [1, {2}] end", "[1, {2}]"),
    ("nothing", "nothing"),
])
def test_json_payload(spark, given, want):
    assert value(spark, text.json_payload, given) == want


def test_report_sections(spark):
    report = (
        "CODE_ANALYSIS:\n good\nlines\n\nIMPROVEMENT_RECOMMENDATIONS:\n- one\n  more\n-two\n-  \n"
        "\n OPTIMIZATION_POTENTIAL: Medium\nFINAL_RECOMMENDATION: CONTINUE OPTIMIZATION"
    )
    df = spark.createDataFrame([(report,), ("IMPROVEMENT_RECOMMENDATIONS: first\n- second",), ("",)], "x string")
    full, part, none = [r.asDict() for r in df.select([c.alias(n) for n, c in text.report_sections(F.col("x")).items()]).collect()]
    assert full == {
        "analysis": "good\nlines", "recommendations": ["one\n  more", "two"], "potential": "Medium",
        "decision": "CONTINUE OPTIMIZATION", "continues": True}
    assert part["recommendations"] == ["first", "second"]
    assert none == {"analysis": None, "recommendations": [], "potential": None, "decision": None, "continues": False}


def test_page_text(spark):
    html = "<html><STYLE>p{}</STYLE><script>var a='<b>';</script><!-- no\n --><p>A &amp;lt; B</p>\n<p>C&nbsp;&#39;d&#39;</p></html>"
    assert value(spark, text.page_text, html) == "A &lt; B C 'd'"


@pytest.mark.parametrize("url, host, path, name", [
    ("https://a-b.example.com:80/x/y.html?q=1#f", "a-b.example.com:80", "/x/y.html", "a_b_example_com:80_y_html"),
    ("http://a.org/", "a.org", "/", "a_org"),
    ("http://a.org", "a.org", "", "a_org"),
    ("http://a.org/x;p=1", "a.org", "/x", "a_org_x"),
    ("httpfoo/guide", "", "httpfoo/guide", "_guide"),
    ("http://[bad/x", None, "/x", None),
])
def test_urls(spark, url, host, path, name):
    df = spark.createDataFrame([(url,)], "u string")
    made = df.select(text.url_host(F.col("u")), text.url_path(F.col("u")), text.source_name(F.col("u"))).first()
    assert made[:] == (host, path, name)


@pytest.mark.parametrize("given, description, tags", [
    ("# Sum rows\n# Tags: sum, fast\n# Metrics: Time=1s\n\nx", "Sum rows", "sum, fast"),
    ("x = 1", "Generated code snippet", ""),
    ("# one\n# two\nx", "two", ""),
    ("\n\n\n\n\n# late", "Generated code snippet", ""),
    ("#no space\n# Tags:", "Generated code snippet", ""),
])
def test_header_fields(spark, given, description, tags):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select([c.alias(n) for n, c in text.header_fields(F.col("x")).items()]).first()[:] == (description, tags)


SMALL = chunks.Profile(10, 4, ("\n\n", "\n", " ", ""))


def cut(given, profile=SMALL):
    return [c for c in map(str.strip, chunks.split_text(given, profile)) if c]


@pytest.mark.parametrize("given, want", [
    ("", []),
    ("short", ["short"]),
    ("aaa bbb ccc ddd", ["aaa bbb", "bbb ccc", "ccc ddd"]),
    ("one\n\ntwo three four\n\nfive", ["one", "two three", "four", "five"]),
    ("abcdefghijklmno", ["abcdefghij", "ghijklmno"]),
    ("a" * 9 + "\n" + "b" * 9, ["a" * 9, "b" * 9]),
])
def test_splitting_at_separators(given, want):
    assert cut(given) == want


@pytest.mark.parametrize("profile", chunks.PROFILES.values(), ids=chunks.PROFILES)
def test_chunks_keep_the_text(spark, profile):
    documents = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for given in documents[:80]:
        # Blanks aside, each chunk begins at most an overlap before the end of the last, and all is covered.
        # Repeated passages fit in several places, so all possible ends are followed.
        bare, ends = "".join(given.split()), {0}
        for chunk in cut(given, profile):
            assert len(chunk) <= profile.size
            piece = "".join(chunk.split())
            starts = {s for e in ends for s in range(max(0, e - profile.overlap), e + 1)}
            ends = {s + len(piece) for s in starts if bare.startswith(piece, s)}
        assert len(bare) in ends


def test_chunk_job_equals_the_function(spark):
    df = spark.createDataFrame([(0, "word " * 600), (1, None), (2, "")], "id int, text string")
    got = chunks.chunk_separators(df, "text").where("id = 0").orderBy("chunk_no").collect()
    assert [r.chunk for r in got] == cut("word " * 600, chunks.CODE_PROFILE)
    assert chunks.chunk_separators(df, "text", "doc").where("id > 0").count() == 0


def test_profile_choice(spark):
    df = spark.createDataFrame(
        [("web", "Pandas Documentation"), ("web", "a blog"), ("documentation", None), ("code_snippet", "documentation")],
        "t string, d string")
    got = [r[0] for r in df.select(chunks.profile_name(F.col("t"), F.col("d"))).collect()]
    assert got == ["doc", "code", "doc", "code"]
