"""How often plans do the same work, and what they shuffle: read from the plans, not from clocks."""

from pyspark.sql import functions as F

from skein import catalog
from skein.operators import graph, ordered, search
from skein.sources import markdown

SF = "/root/testdata/sf0.001"
ODD = "a\r# one\n\n    # no\n```\n# no\n```\nUnder\n=====\r\n`# [x](y)` [b](c.md 't')\n[d]\n\n[d]: e.md\n# Citations\n- [z](z.md)\n"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_searched_for_code_once(spark):
    docs = spark.createDataFrame([(1, ODD)], "k int, text string")
    for found in (markdown.links(docs, ["k"]), markdown.headings(docs, ["k"])):
        plan = optimized(found)
        assert plan.count(markdown.FENCE) == 2 and plan.count(markdown.INDENTED) == 2  # what is between them, and they


def test_links_shuffle_no_text_between_them(spark):
    docs = spark.createDataFrame([(1, "word " * 1000 + "[a](b)\n" + "more " * 1000)], "k int, text string")
    rows = markdown.links(docs, ["k"])
    node, below = rows._jdf.queryExecution().optimizedPlan(), None
    while node.children().size():
        node, above = node.children().apply(0), node
        if above.nodeName() == "Window":
            below = node.output().mkString(" ")
    assert "link" in below and "piece" not in below
    assert [tuple(r) for r in rows.select("line", "context", "href").collect()] == [(1, "a", "b")]


def test_odd_texts_keep_their_headings_links_and_citations(spark):
    docs = spark.createDataFrame([(1, ODD), (2, "no heading"), (3, None), (4, "- a\n --\n"), (5, "# x"), (6, "CITATIONS\n- x")], "k int, text string")
    assert sorted((r.k, r.heading) for r in markdown.headings(docs, ["k"]).collect()) == [(1, "Citations"), (1, "Under"), (1, "one")]
    assert sorted((r.k, r.line, r.href) for r in markdown.links(docs, ["k"]).collect()) == [(1, 10, "c.md"), (1, 11, "e.md"), (1, 15, "z.md")]
    assert [(r.k, r.href) for r in markdown.citations(docs, ["k"]).collect()] == [(1, "z.md")]


def test_a_damaged_index_is_checked_from_stored_tables(spark):
    plan = optimized(catalog.QUERIES["index_invariants"](spark, SF))
    assert "regexp_extract_all" not in plan  # texts were read for each part, and again for each check of one


def test_a_kept_index_is_the_index(spark):
    docs = spark.createDataFrame([("a", "x", 0, "One one two"), ("b", "x", 0, None), ("c", "y", 1, "two"), ("c", "y", 1, "two 3")], "id string, layer string, index_order int, text string")
    kept, made = search.kept_index(docs), search.build_index(docs)
    for name in search.PARTS:
        own = lambda index: sorted(map(tuple, getattr(index, name).select(*sorted(getattr(made, name).columns)).collect()))  # noqa: B023, E731
        assert own(kept) == own(made)
    assert kept.problems().count() == made.problems().count()


def test_edges_meet_only_missing_ids(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "x"), ("e3", "y", "x"), ("e4", None, "b"), ("e5", "x", None)], "id string, source_id string, target_id string")
    found = graph.missing_endpoints(nodes, edges)
    of = lambda id, side, end: (id, f"edge {id} references missing {side} node {end}")
    expected = [of("e2", "target", "x"), of("e3", "source", "y"), of("e3", "target", "x"), ("e4", None), of("e5", "source", "x"), ("e5", None)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert optimized(found).count("LogicalRDD") == 2  # the edges, for each side; the nodes met distinct ends before


def test_no_edges_are_sorted_to_find_their_ends_types(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, node_type string")
    edges = spark.createDataFrame([("R", "a", "b"), ("R", "a", "x"), ("S", None, "a")], "edge_type string, source_id string, target_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.resolve_endpoints(nodes, edges)
        rows = found.select("edge_type", "source_id", "target_id", "from_type", "to_type").collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, rows), key=str) == sorted([("R", "a", "b", "A", "B"), ("R", "a", "x", "A", None), ("S", None, "a", None, "A")], key=str)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_rows_are_numbered_where_they_are_placed(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    placed = ordered.placed(rows, ["v"])
    assert "Window" not in optimized(placed)  # each reader dealt and sorted all rows to number them
    found = sorted(map(tuple, placed.select("part_", "row_", "v").collect()))
    assert [v for _, _, v in found] == list(range(1000))
    assert all(row == 1 if i == 0 or found[i - 1][0] != part else row == found[i - 1][1] + 1 for i, (part, row, _) in enumerate(found))


def test_links_in_circles_are_followed_once(spark):
    links = {0: 1, 1: 2, 2: 0, 5: 6, 6: 1, 7: 8, 9: 9}
    table = spark.createDataFrame(list(links.items()), "at bigint, to bigint")
    for starts, wanted in (([0], {0, 1, 2}), ([5], {0, 1, 2, 5, 6}), ([7, 9], {7, 8, 9}), ([4], {4})):
        found = ordered.reached(spark.createDataFrame([(s,) for s in starts], "at bigint"), table)
        assert sorted(r["at"] for r in found.collect()) == sorted(wanted)
