"""The named graph questions over a code graph made of parts and order lines.

Parts are nodes of all the types that questions ask for; an order line links its part to another one by a
relation. The SQL of each question is written from what it asks, not from its pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans import named
from skein.plans.registry import query, table

TYPES = ("Module", "Class", "Function", "Method", "CallExpression", "ImportDeclaration", "Reference", "Dependency", "File", "Variable", "Constant", "Property", "TypeAlias", "Parameter", "SourceRoot", "APIEndpoint", "Route", "Query", "SecretRef", "DocumentationChunk", "Component", "SyntaxCapture", "Symbol", "DocumentationSource")
RELATIONS = ("ResolvesTo", "Calls", "DependsOn", "Imports", "Defines", "Exposes", "RoutesTo", "ExecutesQuery", "UsesSecret", "Documents", "EvidencedBy", "DerivedFrom")
LABELS = ("main", "cli", "web_server", "handler", "run", "a.b")


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), k).alias("id"), pick(TYPES, k).alias("node_type"), pick(LABELS, k * 7).alias("label"), F.concat(F.lit("pkg.q"), k % 50).alias("qualified_name"), F.concat(F.lit("src/"), F.when(k % 9 == 0, "cli").otherwise("lib"), k % 40, F.lit(".py")).alias("path"),
        F.lower("p_brand").alias("kind"), (k % 90).alias("line_start"), (k % 90 + 5).alias("line_end"), (k * 3).alias("size_bytes"), F.md5(k.cast("string").cast("binary")).alias("content_hash"),
    )


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))  # one row
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    target = (k * 31 + line * 17 + F.col("l_orderkey")) % F.col("n") + 1
    relation = F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), ((F.col("l_orderkey") + line) % len(RELATIONS) + 1).cast("int"))
    return lines.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), relation.alias("edge_type"), F.concat(F.lit("n"), k).alias("source_id"), F.concat(F.lit("n"), target).alias("target_id"), F.lit(None).cast("bigint").alias("child_index"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GRAPH = f"""WITH n AS (SELECT 'n' || p_partkey AS id, {_list(TYPES)}[p_partkey % {len(TYPES)} + 1] AS node_type, {_list(LABELS)}[p_partkey * 7 % {len(LABELS)} + 1] AS label, 'pkg.q' || p_partkey % 50 AS qualified_name, 'src/' || CASE WHEN p_partkey % 9 = 0 THEN 'cli' ELSE 'lib' END || p_partkey % 40 || '.py' AS path,
 lower(p_brand) AS kind, p_partkey % 90 AS line_start, p_partkey % 90 + 5 AS line_end, p_partkey * 3 AS size_bytes, md5(p_partkey::VARCHAR) AS content_hash FROM part),
e AS (SELECT {_list(RELATIONS)}[(l_orderkey + l_linenumber) % {len(RELATIONS)} + 1] AS rel, 'n' || l_partkey AS a, 'n' || ((l_partkey * 31 + l_linenumber * 17 + l_orderkey) % (SELECT count(*) FROM part) + 1) AS b FROM lineitem),
h AS (SELECT rel, x.*, y.id AS b_id, y.node_type AS b_type, y.label AS b_label, y.qualified_name AS b_name, y.path AS b_path, y.line_start AS b_start, y.line_end AS b_end FROM e JOIN n x ON x.id = a JOIN n y ON y.id = b)"""


def _hop(relation: str, columns: str, where: str = "true") -> str:
    return f"SELECT {columns} FROM h WHERE rel = '{relation}' AND {where}"


def _ask(question: str, sql: str, limit: int, order: str = "", /, **parameters: str) -> None:
    """``sql`` gives the rows; after ``order`` columns decide from left to right."""
    places = "ALL" if not order else order
    statement = f"{GRAPH} SELECT * FROM ({sql}) ORDER BY {places} LIMIT {limit}"

    @query(f"ask_{question}", statement)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return named.ask(question, code_nodes(spark, sf_dir), code_edges(spark, sf_dir), **parameters)


_ask("repository_overview", "SELECT id, label, path FROM n WHERE node_type IN ('SourceRoot', 'File', 'Module', 'Dependency', 'APIEndpoint', 'Component')", 100)
_ask("symbol_lookup", "SELECT id, label, qualified_name, path FROM n WHERE node_type IN ('Class', 'Function', 'Method', 'Variable', 'Constant', 'ClassAttribute', 'InstanceAttribute', 'Property', 'Parameter', 'TypeAlias') AND (label = 'pkg.q7' OR qualified_name = 'pkg.q7')", 25, name="pkg.q7")
_ask("definition_context", "SELECT id, label, kind, path FROM n WHERE node_type IN ('Class', 'Function', 'Method', 'Variable', 'Constant')", 50)
_ask("callgraph_neighborhood", _hop("ResolvesTo", "id AS call_id, path, b_id AS target_id, b_label AS target_label", "node_type = 'CallExpression'"), 50)
_ask("dependency_map", _hop("DependsOn", "id AS import_id, label AS import_label, b_id AS dependency_id, b_label AS dependency_label", "node_type = 'ImportDeclaration' AND b_type = 'Dependency'"), 100)
_ask("runtime_surface", _hop("RoutesTo", "id AS route_id, label AS route_label, b_id AS endpoint_id, b_label AS endpoint_label", "node_type = 'Route' AND b_type = 'APIEndpoint'"), 100)
_ask("documentation_context", _hop("Documents", "id AS doc_id, label AS doc_label, b_id AS node_id, b_label AS node_label", "node_type = 'DocumentationChunk'"), 50)
LOST = "SELECT id, label, path, line_start FROM n WHERE node_type = 'Reference' AND id NOT IN (SELECT a FROM e WHERE rel = 'ResolvesTo')"
_ask("unresolved_references", LOST, 100)
_ask("unresolved_reference_risk", LOST, 200, "path, line_start, id, label")
_ask("graph_coverage", "SELECT (SELECT count(*) FROM n) + (SELECT count(*) FROM e) AS total_nodes", 1)
_ask("source_unit_inventory", "SELECT id, label, qualified_name, path, line_start, line_end FROM n WHERE node_type = 'Module'", 200, "path, id")
_ask("package_directory_shape", "SELECT path, label, size_bytes, content_hash FROM n WHERE node_type = 'File'", 300, "path, label, size_bytes")
SURFACE = "label AS module_label, path AS module_path, b_id AS surface_id, b_label AS surface_label, b_name AS surface_qualified_name, b_path AS surface_path, b_start AS line_start"
_ask("public_surface_candidates", _hop("Exposes", "'exposed' AS surface_source, " + SURFACE, "node_type = 'Module'") + " UNION ALL " + _hop("Defines", "'defined', " + SURFACE, "node_type = 'Module' AND b_type IN ('Class', 'Function', 'Method')"), 200)
_ask("entrypoint_runtime_surface", "SELECT 'name_candidate' AS entrypoint_kind, id AS entrypoint_id, label AS entrypoint_label, path AS entrypoint_path, id AS target_id, label AS target_label, qualified_name AS target_qualified_name, path AS target_path, line_start FROM n WHERE node_type = 'Function' AND (label IN ('main', 'cli') OR contains(label, 'server') OR contains(path, 'cli'))", 100)
_ask("external_dependency_map", _hop("DependsOn", "path, label AS import_label, b_label AS dependency", "node_type = 'ImportDeclaration' AND b_type = 'Dependency'"), 300, "dependency, path, import_label")
_ask("module_import_coupling", _hop("Imports", "label AS module_label, path AS module_path, b_label AS import_label, b_start AS line_start", "node_type = 'Module' AND b_type = 'ImportDeclaration'"), 300, "module_path, line_start, module_label, import_label")
_ask("high_fan_in_definitions", "SELECT b_id AS id, b_label AS label, b_name AS qualified_name, b_path AS path, count(*) AS inbound_refs FROM h WHERE rel = 'ResolvesTo' AND b_type IN ('Class', 'Function', 'Method', 'Module') GROUP BY ALL", 50, "inbound_refs DESC, id")
_ask("high_fan_out_callers", "SELECT id, label, qualified_name, path, count(*) AS outgoing_calls FROM h WHERE rel = 'Calls' AND node_type IN ('Function', 'Method') GROUP BY ALL", 50, "outgoing_calls DESC, id")
_ask("callable_neighborhood", _hop("Calls", "id AS caller_id, label AS caller_label, qualified_name AS caller_qualified_name, b_id AS callee_id, b_label AS callee_label, b_name AS callee_qualified_name, b_path AS callee_path", "(label = 'pkg.q3' OR qualified_name = 'pkg.q3')"), 100, name="pkg.q3")
ACTOR = "id AS actor_id, label AS actor_label, qualified_name AS actor_qualified_name, path AS actor_path"
_ask("data_query_touchpoints", _hop("ExecutesQuery", ACTOR + ", b_label AS query_label, b_path AS query_path, b_start AS query_line_start", "b_type = 'Query'"), 100)
_ask("secret_configuration_touchpoints", _hop("UsesSecret", ACTOR + ", b_label AS secret_label, b_path AS secret_path, b_start AS secret_line_start", "b_type = 'SecretRef'"), 100)
_ask("documentation_to_code_links", _hop("Documents", "id AS doc_id, label AS doc_label, path AS doc_path, b_id AS node_id, b_label AS node_label, b_name AS node_qualified_name, b_path AS node_path", "node_type = 'DocumentationChunk'"), 100)
_ask("evidence_for_symbol", _hop("EvidencedBy", "id AS node_id, label AS node_label, qualified_name AS node_qualified_name, path AS node_path, b_id AS evidence_id, b_label AS evidence_label, b_path AS evidence_path, b_start AS evidence_line_start, b_end AS evidence_line_end", "(label = 'main' OR qualified_name = 'main')"), 100, name="main")
