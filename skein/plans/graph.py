"""Graph queries over the star schema read as a graph.

Nodes are regions, nations, customers, suppliers, parts and orders; edges are InRegion, InNation, Placed and
Contains (an order's parts by line number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import graph_id, partition_id, round6
from skein.operators import graph as G
from skein.plans.patterns import compile_pattern
from skein.plans.registry import query, table

NODES = {"Region": ("region", "r_regionkey", "r_name"), "Nation": ("nation", "n_nationkey", "n_name"), "Customer": ("customer", "c_custkey", "c_name"), "Supplier": ("supplier", "s_suppkey", "s_name"), "Part": ("part", "p_partkey", "p_name"), "Order": ("orders", "o_orderkey", "o_orderpriority")}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, (name, key, label) in NODES.items():
        part = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"), F.concat_ws(".", F.lit(name), label).alias("qualified_name"), F.lit(f"{name}.tbl").alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(df: DataFrame, kind: str, source: Column, target: Column, child: Column | None = None) -> DataFrame:
        e = df.select(F.lit(kind).alias("edge_type"), source.alias("source_id"), target.alias("target_id"), (child if child is not None else F.lit(None)).cast("bigint").alias("child_index"))
        return e.withColumn("id", F.concat_ws("|", "edge_type", "source_id", "target_id", "child_index"))

    t = lambda name: table(spark, sf_dir, name)
    c = lambda kind, key: F.concat(F.lit(f"{kind}:"), key)
    return (
        link(t("nation"), "InRegion", c("Nation", "n_nationkey"), c("Region", "n_regionkey"))
        .unionByName(link(t("customer"), "InNation", c("Customer", "c_custkey"), c("Nation", "c_nationkey")))
        .unionByName(link(t("supplier"), "InNation", c("Supplier", "s_suppkey"), c("Nation", "s_nationkey")))
        .unionByName(link(t("orders"), "Placed", c("Customer", "o_custkey"), c("Order", "o_orderkey")))
        .unionByName(link(t("lineitem"), "Contains", c("Order", "l_orderkey"), c("Part", "l_partkey"), F.col("l_linenumber")))
    )


N = " UNION ALL ".join(f"SELECT '{kind}:' || {key} AS id, '{kind}' AS node_type, {label} AS label, '{name}.' || {label} AS qualified_name, '{name}.tbl' AS path FROM {name}" for kind, (name, key, label) in NODES.items())
E_ = """SELECT *, concat_ws('|', edge_type, source_id, target_id, child_index) AS id FROM (
 SELECT 'InRegion' AS edge_type, 'Nation:' || n_nationkey AS source_id, 'Region:' || n_regionkey AS target_id, NULL::BIGINT AS child_index FROM nation
 UNION ALL SELECT 'InNation', 'Customer:' || c_custkey, 'Nation:' || c_nationkey, NULL FROM customer
 UNION ALL SELECT 'InNation', 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, NULL FROM supplier
 UNION ALL SELECT 'Placed', 'Customer:' || o_custkey, 'Order:' || o_orderkey, NULL FROM orders
 UNION ALL SELECT 'Contains', 'Order:' || l_orderkey, 'Part:' || l_partkey, l_linenumber::BIGINT FROM lineitem)"""
WITH = f"WITH RECURSIVE n AS ({N}), e AS ({E_})"


@query("graph_counts", f"{WITH} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n) + (SELECT count(*) FROM e) AS reified_nodes")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counts(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("multi_label_scan", f"{WITH} SELECT id, node_type, label FROM n WHERE node_type IN ('Region', 'Nation', 'Supplier') ORDER BY id LIMIT 100")
def multi_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.of_types(nodes(spark, sf_dir), ["Region", "Nation", "Supplier"]).select("id", "node_type", "label").orderBy("id").limit(100)


@query("symbol_lookup", f"{WITH} SELECT id, node_type, label, qualified_name FROM n WHERE node_type IN ('Region', 'Nation', 'Part', 'Order') AND (label = '1-URGENT' OR qualified_name = '1-URGENT') ORDER BY id LIMIT 25")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symbol_lookup(nodes(spark, sf_dir), "1-URGENT", ["Region", "Nation", "Part", "Order"]).select("id", "node_type", "label", "qualified_name")


@query("typed_hop", f"{WITH} SELECT a.id AS a_id, a.label AS a_label, b.id AS b_id, b.label AS b_label FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = 'InNation' AND a.node_type = 'Customer' AND b.node_type = 'Nation'")
def typed_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hop(nodes(spark, sf_dir), edges(spark, sf_dir), "InNation", ["Customer"], ["Nation"]).select("a_id", "a_label", "b_id", "b_label")


@query("sorted_hop", f"{WITH} SELECT b.label AS b_label, a.path AS a_path, a.id AS a_id FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = 'Contains' ORDER BY b.label, a.id, a.path LIMIT 300")
def sorted_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hop(nodes(spark, sf_dir), edges(spark, sf_dir), "Contains").select("b_label", "a_path", "a_id").orderBy("b_label", "a_id", "a_path").limit(300)


@query("contains_filter", f"{WITH} SELECT id, label FROM n WHERE label = 'ASIA' OR contains(label, 'Customer#') OR contains(path, 'nation') ORDER BY id LIMIT 200")
def contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("label")
    return nodes(spark, sf_dir).where((c == "ASIA") | c.contains("Customer#") | F.col("path").contains("nation")).select("id", "label").orderBy("id").limit(200)


@query("neighbors_in_out", f"{WITH} SELECT origin, direction, relation, neighbor_id, node_type AS neighbor_type, child_index, chain FROM (SELECT source_id AS origin, 'outgoing' AS direction, edge_type AS relation, target_id AS neighbor_id, child_index, edge_type || ':' || source_id || '->' || target_id AS chain FROM e UNION ALL SELECT target_id, 'incoming', edge_type, source_id, child_index, edge_type || ':' || source_id || '->' || target_id FROM e) x JOIN n ON n.id = neighbor_id WHERE relation IN ('InNation', 'Placed') AND origin IN (SELECT 'Customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def neighbors_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("Customer:"), "c_custkey").alias("id"))
    return G.neighbors(nodes(spark, sf_dir), edges(spark, sf_dir), ["InNation", "Placed"], starts)


@query("unresolved_anti", f"{WITH} SELECT id, node_type, label FROM n WHERE node_type IN ('Customer', 'Supplier') AND NOT EXISTS (SELECT 1 FROM e WHERE edge_type = 'Placed' AND source_id = n.id)")
def unresolved_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.without(nodes(spark, sf_dir), edges(spark, sf_dir), "Placed", ["Customer", "Supplier"]).select("id", "node_type", "label")


FAN = "SELECT edge_type, id, node_type, label, degree FROM (SELECT edge_type, {0}_id AS id, count(*) AS degree FROM e WHERE edge_type IN ({1}) GROUP BY ALL ORDER BY degree DESC, edge_type, id LIMIT 50) f JOIN n USING (id)"


@query("fan_in_topk", f"{WITH} " + FAN.format("target", "'InNation', 'Contains', 'InRegion', 'Placed'"))
def fan_in_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fan(edges(spark, sf_dir), nodes(spark, sf_dir), ["InNation", "Contains", "InRegion", "Placed"], incoming=True)


@query("fan_out_topk", f"{WITH} " + FAN.format("source", "'Placed', 'Contains'"))
def fan_out_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fan(edges(spark, sf_dir), nodes(spark, sf_dir), ["Placed", "Contains"], incoming=False)


@query("union_surface", f"{WITH} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{tag}' AS surface, a.id AS a_id, b.label AS b_label FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = '{r}'" for tag, r in (("region", "InRegion"), ("nation", "InNation"), ("placed", "Placed"))) + ") ORDER BY surface, a_id, b_label LIMIT 200")
def union_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, out = nodes(spark, sf_dir), edges(spark, sf_dir), None
    for tag, relation in (("region", "InRegion"), ("nation", "InNation"), ("placed", "Placed")):
        part = G.hop(n, e, relation).select(F.lit(tag).alias("surface"), "a_id", "b_label")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("surface", "a_id", "b_label").limit(200)


@query("khop_bfs", f"{WITH}, l AS (SELECT source_id a, target_id b FROM e UNION SELECT target_id, source_id FROM e), w AS (SELECT 'Nation:3' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN l ON a = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id")
def khop_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach(edges(spark, sf_dir), spark.createDataFrame([("Nation:3",)], "id string"), 3)


@query("context_bounded", f"{WITH}, x AS (SELECT 'outgoing' AS direction, edge_type AS relation, target_id AS neighbor_id FROM e WHERE source_id = 'Nation:1' UNION ALL SELECT 'incoming', edge_type, source_id FROM e WHERE target_id = 'Nation:1'), o AS (SELECT direction, relation, node_type AS neighbor_type, neighbor_id, CAST(row_number() OVER (ORDER BY CASE relation WHEN 'InRegion' THEN 0 ELSE 1 END, direction DESC, node_type, neighbor_id) - 1 AS INTEGER) AS position FROM x JOIN n ON id = neighbor_id WHERE relation IN ('InRegion', 'InNation')) SELECT * FROM o WHERE position < 12")
def context_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.context(nodes(spark, sf_dir), edges(spark, sf_dir), "Nation:1", ["InRegion", "InNation"], limit=12)
    return found.select("direction", "relation", "neighbor_type", "neighbor_id", "position")


@query("endpoint_resolution", f"{WITH}, bad AS (SELECT edge_type, source_id, CASE WHEN child_index = 7 THEN 'Part:none' ELSE target_id END AS target_id, child_index, id FROM e) SELECT b.id AS edge_id, 'edge ' || b.id || ' references missing target node ' || target_id AS message FROM bad b LEFT JOIN n ON n.id = target_id WHERE n.id IS NULL")
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = edges(spark, sf_dir).withColumn("target_id", F.when(F.col("child_index") == 7, "Part:none").otherwise(F.col("target_id")))
    return G.missing_endpoints(nodes(spark, sf_dir), broken)


@query("endpoint_types", f"{WITH} SELECT edge_type, a.node_type AS from_type, b.node_type AS to_type, count(*) AS n FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id GROUP BY ALL")
def endpoint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_endpoints(nodes(spark, sf_dir), edges(spark, sf_dir)).groupBy("edge_type", "from_type", "to_type").agg(F.count("*").alias("n"))


#: The star schema's types under names that the relations' table knows.
CODE = {"Region": "Repository", "Nation": "Module", "Customer": "Function", "Supplier": "Class", "Part": "Symbol", "Order": "CallExpression"}
RELATIONS = {"InRegion": "Contains", "InNation": "Calls", "Placed": "Calls", "Contains": "ResolvesTo"}


@query("relation_constraint", f"{WITH}, t AS (SELECT CASE edge_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items()) + " END AS edge_type, " + ", ".join(f"CASE {s}.node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE.items()) + f" END AS {c}" for s, c in (("a", "from_type"), ("b", "to_type"))) + " FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id) SELECT edge_type, from_type, to_type, count(*) AS n FROM t WHERE edge_type NOT IN ('Calls', 'ResolvesTo') OR (edge_type = 'Calls' AND from_type IN ('Function', 'CallExpression') AND to_type IN ('CallExpression', 'Class', 'Function')) OR (edge_type = 'ResolvesTo' AND from_type = 'CallExpression' AND to_type IN ('Symbol', 'Class', 'Function', 'Module')) GROUP BY ALL")
def relation_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    swap = lambda c, names: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(c))
    resolved = G.resolve_endpoints(nodes(spark, sf_dir), edges(spark, sf_dir)).select(swap("edge_type", RELATIONS).alias("edge_type"), swap("from_type", CODE).alias("from_type"), swap("to_type", CODE).alias("to_type"))
    return G.constrained(resolved).groupBy("edge_type", "from_type", "to_type").agg(F.count("*").alias("n"))


@query("connector_rows", f"{WITH}, r AS (SELECT e.*, a.node_type AS ft, b.node_type AS tt FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = 'InNation') SELECT DISTINCT edge_type AS relation, 'source' AS side, ft AS from_type, edge_type AS to_type, source_id AS from_id, id AS to_id, 'source' AS role FROM r UNION SELECT edge_type, 'target', edge_type, tt, id, target_id, 'target' FROM r")
def connector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connectors(G.resolve_endpoints(nodes(spark, sf_dir), edges(spark, sf_dir).where("edge_type = 'InNation'")))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for one id of each (source, lang): now and then a field is missing."""
    return table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source").alias("id"), F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("label"), "doc_id")).alias("label"), F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("n_chars")).alias("line_start"), F.concat(F.lit("t"), "doc_id").alias("text"), F.when(F.col("doc_id") % 5 < 3, "{}").otherwise(F.concat(F.lit('{"n": '), "doc_id", F.lit("}"))).alias("metadata"), F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(1.0).alias("confidence"))


DUPLICATES = "d AS (SELECT lang || ':' || source AS id, doc_id AS at_, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'label' || doc_id END AS label, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE n_chars END AS line_start, 't' || doc_id AS text, CASE WHEN doc_id % 5 < 3 THEN '{}' ELSE '{\"n\": ' || doc_id || '}' END AS metadata, CASE WHEN doc_id % 4 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM documents)"


@query("first_non_empty_merge", f"WITH {DUPLICATES} SELECT id, coalesce(arg_min(label, at_) FILTER (label <> ''), '') AS label, arg_min(line_start, at_) FILTER (line_start IS NOT NULL) AS line_start, arg_min(text, at_) AS text, coalesce(arg_min(metadata, at_) FILTER (metadata <> '{{}}'), '{{}}') AS metadata, coalesce(arg_min(confidence, at_) FILTER (confidence <> 1), 1.0::DOUBLE) AS confidence FROM d GROUP BY id")
def first_non_empty_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_first(duplicates(spark, sf_dir), ["id"], "at", ["label"], ["line_start"], ["text"], ["metadata"], {"confidence": 1.0})


@query("first_type_per_id", "SELECT lang || ':' || source AS id, arg_min(CASE doc_id % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'Symbol' ELSE 'File' END, doc_id) AS node_type FROM documents GROUP BY 1")
def first_type_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source").alias("id"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "Class").when(F.col("doc_id") % 3 == 1, "Symbol").otherwise("File").alias("node_type"))
    return G.first_type(d, "doc_id")


@query("label_resolution_latest", "WITH x AS (SELECT 'u' || user_id % 50 AS path, event_id, ts, event_type FROM events), d AS (SELECT path, 'def' || event_id AS def_id, event_type AS label, event_id AS pos FROM x WHERE event_id % 3 = 0), r AS (SELECT path, 'ref' || event_id AS ref_id, CASE WHEN event_id % 2 = 0 THEN ' ' || upper(event_type) || ' ' ELSE 'pkg.' || event_type END AS label, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type END AS key, event_id AS pos FROM x WHERE event_id % 3 <> 0), j AS (SELECT r.path, r.ref_id, r.label, d.def_id FROM r ASOF LEFT JOIN d ON r.path = d.path AND r.key = d.label AND r.pos > d.pos) SELECT path, ref_id, label, coalesce(def_id, 'Symbol:' || path || '|' || label) AS target_id, def_id IS NULL AS placeholder FROM j")
def label_resolution_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("path"), "event_id", "event_type")
    definitions = x.where("event_id % 3 = 0").select("path", F.concat(F.lit("def"), "event_id").alias("def_id"), F.col("event_type").alias("label"), F.col("event_id").alias("at"))
    label = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).otherwise(F.concat(F.lit("pkg."), "event_type"))
    references = x.where("event_id % 3 <> 0").select("path", F.concat(F.lit("ref"), "event_id").alias("ref_id"), label.alias("label"), F.col("event_id").alias("at"))
    return G.resolve_labels(references, definitions)


@query("graph_identity", "SELECT o_orderkey, 'Order:' || substr(sha1('orders.tbl|Order|' || o_orderpriority || '|' || o_orderkey), 1, 20) AS node_id, substr(sha1('src/' || o_orderkey || '.py'), 1, 20) AS partition_id, sha256(o_orderstatus || o_orderkey) AS content_hash FROM orders")
def graph_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("orders.tbl|Order|"), "o_orderpriority", F.lit("|"), "o_orderkey")
    return o.select("o_orderkey", graph_id("Order", key).alias("node_id"), partition_id(F.concat(F.lit("src/"), "o_orderkey", F.lit(".py"))).alias("partition_id"), F.sha2(F.concat("o_orderstatus", "o_orderkey"), 256).alias("content_hash"))


@query("merkle_digest", "WITH f AS (SELECT source, sha256(text) AS h, doc_id FROM documents) SELECT source, sha256(string_agg(doc_id || ':' || h, chr(10) ORDER BY doc_id)) AS digest, count(*) AS files FROM f GROUP BY source")
def merkle_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    lines = F.array_sort(F.collect_list(F.struct("doc_id", "h")))
    joined = F.array_join(F.transform(lines, lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["h"])), "\n")
    return files.groupBy("source").agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("files"))


@query("rounded_scores", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / 7.0::DOUBLE * 1e6) / 1e6 AS score FROM lineitem")
def rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", round6(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.lit(7.0)).alias("score"))


HOP = "(a:{0})-[:FROM_{1}]->(:{1})-[:TO_{1}]->(b:{2})"


@query("pattern_hop", f"{WITH} SELECT a.id AS a_id, b.label AS nation FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = 'InNation' AND a.node_type = 'Supplier' AND (b.label = 'NATION_3' OR contains(b.label, '1')) ORDER BY a_id, nation LIMIT 40")
def pattern_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = f"MATCH {HOP.format('Supplier', 'InNation', 'Nation')} WHERE b.label = $name OR b.label CONTAINS '1' RETURN a.id AS a_id, b.label AS nation ORDER BY a.id, b.label LIMIT 40"
    return compile_pattern(statement, nodes(spark, sf_dir), edges(spark, sf_dir), {"name": "NATION_3"})


@query("pattern_not_exists", f"{WITH} SELECT id, label FROM n WHERE node_type = 'Customer' AND NOT EXISTS (SELECT 1 FROM e JOIN n o ON o.id = target_id WHERE edge_type = 'Placed' AND source_id = n.id AND o.label = '1-URGENT')")
def pattern_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:FROM_Placed]->(:Placed)-[:TO_Placed]->(o:Order) WHERE o.label = '1-URGENT' } RETURN c.id, c.label"
    return compile_pattern(statement, nodes(spark, sf_dir), edges(spark, sf_dir))


@query("pattern_union_counts", f"{WITH} SELECT b.label AS label, 'region' AS kind, count(*) AS uses FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = 'InRegion' GROUP BY ALL UNION ALL SELECT b.label, 'nation', count(*) FROM e JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE edge_type = 'InNation' GROUP BY ALL ORDER BY uses DESC, label, kind LIMIT 20")
def pattern_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = "MATCH (a)-[:InRegion]->(b:Region) RETURN b.label AS label, 'region' AS kind, count(a) AS uses UNION ALL MATCH (a)-[:InNation]->(b) WHERE b:Nation RETURN b.label AS label, 'nation' AS kind, count(a) AS uses ORDER BY uses DESC, label, kind LIMIT 20"
    return compile_pattern(statement, nodes(spark, sf_dir), edges(spark, sf_dir))


@query("pattern_two_hops", f"{WITH} SELECT r.label AS region, count(*) AS customers FROM e e1 JOIN e e2 ON e1.target_id = e2.source_id JOIN n c ON c.id = e1.source_id JOIN n r ON r.id = e2.target_id WHERE e1.edge_type = 'InNation' AND e2.edge_type = 'InRegion' AND c.node_type = 'Customer' GROUP BY r.label")
def pattern_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_pattern("MATCH (c:Customer)-[:InNation]->(:Nation)-[:InRegion]->(r:Region) RETURN r.label AS region, count(c) AS customers", nodes(spark, sf_dir), edges(spark, sf_dir))
