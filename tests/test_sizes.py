"""Plans whose work must not grow faster than their input."""

from pyspark.sql import functions as F

from skein.plans import build
from skein.sources import code


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_edges_meet_no_nodes(spark, without_codegen):
    """an edge's ends are known by their ids; unwanted types go before the shuffle."""
    files = spark.createDataFrame([("a.py", "python", b"def f(x):\n    return g(x)\n")], "path string, language string, content binary")
    syntax = code.parse_files(files)
    nodes, edges = code.build_graph(syntax)
    assert "Join" not in plan(edges)
    types, relations = ("Function", "CallExpression", "Symbol"), ("Calls", "ResolvesTo")
    some, few = code.build_graph(syntax, node_types=types, edge_types=relations, columns=("label",))
    assert sorted(some.select("id", "label").collect()) == sorted(nodes.where(F.col("node_type").isin(*types)).select("id", "label").collect())
    assert sorted(map(str, few.collect())) == sorted(map(str, edges.where(F.col("edge_type").isin(*relations)).collect())) != []


def test_words_of_a_text_are_found_once(spark):
    """a part of a written file doesn't look for the words again."""
    files = build.text_files(spark.createDataFrame([(1, "documents holding several laborious sentences")], "doc_id long, text string"))
    assert plan(files).count("regexp_extract_all") == 1


def test_terms_of_odd_capitals(spark):
    """texts are lower-cased whole but where that would join or split terms."""
    from skein.functions.text import ascii_lower, code_terms, plain_code_terms, wiki_terms

    texts = ["ΟΔΟΣ ΣΑΣ", "İstanbul ISIK", "Straße ÄÖÜ ǅ Ⅷ Ⓐ", "x" * 300 + " " + "É" * 200, "", "AbC_1 d.E"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", code_terms(F.col("t")).alias("terms"), ascii_lower(F.col("t")).alias("low")).collect()
    assert [r["terms"] for r in rows] == [plain_code_terms(t) for t in texts]
    assert [r["low"] for r in rows] == ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    # the terms of a text are found once
    from skein.plans.search import wiki_tokenize

    assert plan(wiki_tokenize(spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 1
