"""Named graph questions: graph patterns, with the columns they return, their order and their limit.

A question is compiled by ``skein.plans.patterns``. Where rows tie in its order, or it has none, its columns
decide from left to right, so a limit always keeps the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.plans.patterns import compile_pattern


@dataclass(frozen=True)
class Question:
    group: str
    about: str
    statement: str
    limit: int
    order: tuple[str, ...] = ()  # column names, with a minus sign for falling order
    parameters: tuple[str, ...] = ()


CATALOG: dict[str, Question] = {}
#: The order in which to ask an unknown code base.
GROUPS = ("overview", "public_surface", "dependency_topology", "execution_flow", "runtime_data_security", "documentation_context", "graph_quality_gaps")


def _returns(**columns: str) -> str:
    """RETURN items from ``name="variable.property"``; a bare word in quotes stays a literal."""
    return "RETURN " + ", ".join(f"{value} AS {name}" for name, value in columns.items())


def _hop(a: str, relation: str, b: str, **columns: str) -> str:
    return f"MATCH ({a})-[:{relation}]->({b}) {_returns(**columns)}"


def _add(name: str, group: str, about: str, *statements: str, limit: int, order: tuple[str, ...] = (), parameters: tuple[str, ...] = ()) -> None:
    CATALOG[name] = Question(group, about, " UNION ALL ".join(statements), limit, order, parameters)


def _of(variable: str, prefix: str, *properties: str) -> dict[str, str]:
    return {f"{prefix}{p}": f"{variable}.{p}" for p in properties}


NAMED = "WHERE {0}.label = $name OR {0}.qualified_name = $name"
#: The types that each question is about, and their limits (fixed values).
OVERVIEW = ("SourceRoot", "File", "Module", "Dependency", "APIEndpoint", "Component")
SYMBOLS = ("Class", "Function", "Method", "Variable", "Constant", "ClassAttribute", "InstanceAttribute", "Property", "Parameter", "TypeAlias")
DEFINITIONS = ("Class", "Function", "Method", "Variable", "Constant")
REFERRED = ("Class", "Function", "Method", "Module")
CALLERS = ("Function", "Method")
EXPOSED = ("Class", "Function", "Method")

_any = lambda types: "WHERE " + " OR ".join(f"n:{t}" for t in types)
_add("repository_overview", "helpers", "Source roots, files, modules, dependencies and runtime surfaces", f"MATCH (n) {_any(OVERVIEW)} {_returns(**_of('n', '', 'id', 'label', 'path'))}", limit=100)
_add("symbol_lookup", "helpers", "Definitions of a name", *[f"MATCH (s:{t}) {NAMED.format('s')} {_returns(**_of('s', '', 'id', 'label', 'qualified_name', 'path'))}" for t in SYMBOLS], limit=25, parameters=("name",))
_add("definition_context", "helpers", "Definitions", f"MATCH (n) {_any(DEFINITIONS)} {_returns(**_of('n', '', 'id', 'label', 'kind', 'path'))}", limit=50)
_add("callgraph_neighborhood", "helpers", "Calls and what they resolve to", _hop("c:CallExpression", "ResolvesTo", "t", call_id="c.id", path="c.path", target_id="t.id", target_label="t.label"), limit=50)
_add("dependency_map", "helpers", "Imports and dependencies", _hop("i:ImportDeclaration", "DependsOn", "d:Dependency", import_id="i.id", import_label="i.label", dependency_id="d.id", dependency_label="d.label"), limit=100)
_add("runtime_surface", "helpers", "Routes and their endpoints", _hop("r:Route", "RoutesTo", "e:APIEndpoint", route_id="r.id", route_label="r.label", endpoint_id="e.id", endpoint_label="e.label"), limit=100)
_add("documentation_context", "helpers", "What documentation is about", _hop("d:DocumentationChunk", "Documents", "n", doc_id="d.id", doc_label="d.label", node_id="n.id", node_label="n.label"), limit=50)

_unresolved = f"MATCH (r:Reference) WHERE NOT EXISTS {{ MATCH (r)-[:ResolvesTo]->() }} {_returns(**_of('r', '', 'id', 'label', 'path', 'line_start'))}"
_add("unresolved_references", "helpers", "References without a target", _unresolved, limit=100)
_add("unresolved_reference_risk", "graph_quality_gaps", "References without a target, by path", _unresolved, limit=200, order=("path", "line_start"))

_add("graph_coverage", "overview", "How many nodes there are, edges counted as nodes", "MATCH (n) RETURN count(n) AS total_nodes", limit=1)
_add("source_unit_inventory", "overview", "Modules with their spans", f"MATCH (m:Module) {_returns(**_of('m', '', 'id', 'label', 'qualified_name', 'path', 'line_start', 'line_end'))}", limit=200, order=("path",))
_add("package_directory_shape", "overview", "Files with sizes and hashes", f"MATCH (f:File) {_returns(**_of('f', '', 'path', 'label', 'size_bytes', 'content_hash'))}", limit=300, order=("path",))

_surface = {"module_label": "m.label", "module_path": "m.path", **_of("s", "surface_", "id", "label", "qualified_name", "path"), "line_start": "s.line_start"}
_add("public_surface_candidates", "public_surface", "What modules expose or define", _hop("m:Module", "Exposes", "s", surface_source="'exposed'", **_surface), *[_hop("m:Module", "Defines", f"s:{t}", surface_source="'defined'", **_surface) for t in EXPOSED], limit=200)
_entry = {"entrypoint_kind": "'name_candidate'", **_of("d", "entrypoint_", "id", "label", "path"), **_of("d", "target_", "id", "label", "qualified_name", "path"), "line_start": "d.line_start"}
_add("entrypoint_runtime_surface", "public_surface", "Functions that look like entry points", f"MATCH (d:Function) WHERE d.label = 'main' OR d.label = 'cli' OR d.label CONTAINS 'server' OR d.path CONTAINS 'cli' {_returns(**_entry)}", limit=100)

_add("external_dependency_map", "dependency_topology", "Imports by dependency", _hop("i:ImportDeclaration", "DependsOn", "d:Dependency", path="i.path", import_label="i.label", dependency="d.label"), limit=300, order=("dependency", "path"))
_add("module_import_coupling", "dependency_topology", "What modules import", _hop("m:Module", "Imports", "i:ImportDeclaration", module_label="m.label", module_path="m.path", import_label="i.label", line_start="i.line_start"), limit=300, order=("module_path", "line_start"))

_add("high_fan_in_definitions", "execution_flow", "Definitions that most references reach", *[_hop("r", "ResolvesTo", f"t:{t}", **_of("t", "", "id", "label", "qualified_name", "path"), inbound_refs="count(r)") for t in REFERRED], limit=50, order=("-inbound_refs",))
_add("high_fan_out_callers", "execution_flow", "Callables that call most", *[_hop(f"c:{t}", "Calls", "d", **_of("c", "", "id", "label", "qualified_name", "path"), outgoing_calls="count(d)") for t in CALLERS], limit=50, order=("-outgoing_calls",))
_add("callable_neighborhood", "execution_flow", "What a named callable calls", f"MATCH (a)-[:Calls]->(b) {NAMED.format('a')} {_returns(**_of('a', 'caller_', 'id', 'label', 'qualified_name'), **_of('b', 'callee_', 'id', 'label', 'qualified_name', 'path'))}", limit=100, parameters=("name",))

_touch = lambda relation, target, prefix: _hop("a", relation, f"b:{target}", **_of("a", "actor_", "id", "label", "qualified_name", "path"), **_of("b", prefix, "label", "path", "line_start"))
_add("data_query_touchpoints", "runtime_data_security", "What runs queries", _touch("ExecutesQuery", "Query", "query_"), limit=100)
_add("secret_configuration_touchpoints", "runtime_data_security", "What uses secrets", _touch("UsesSecret", "SecretRef", "secret_"), limit=100)

_add("documentation_to_code_links", "documentation_context", "Documentation of code", _hop("d:DocumentationChunk", "Documents", "n", **_of("d", "doc_", "id", "label", "path"), **_of("n", "node_", "id", "label", "qualified_name", "path")), limit=100)
_add("evidence_for_symbol", "documentation_context", "The evidence for a named symbol", f"MATCH (n)-[:EvidencedBy]->(e) {NAMED.format('n')} {_returns(**_of('n', 'node_', 'id', 'label', 'qualified_name', 'path'), **_of('e', 'evidence_', 'id', 'label', 'path', 'line_start', 'line_end'))}", limit=100, parameters=("name",))

#: Properties that questions return, with their types: null where a graph has no such column.
PROPERTIES = {"kind": "string", "path": "string", "qualified_name": "string", "line_start": "bigint", "line_end": "bigint", "size_bytes": "bigint", "content_hash": "string"}


def ask(question: str, nodes: DataFrame, edges: DataFrame, /, **parameters: str) -> DataFrame:
    if question not in CATALOG:
        raise KeyError(f"unknown query {question}; known: {', '.join(sorted(CATALOG))}")
    asked = CATALOG[question]
    if question == "graph_coverage":  # edges are nodes of the reified graph
        return G.counts(nodes, edges).select(F.col("reified_nodes").alias("total_nodes"))
    if "size_bytes" not in nodes.columns and "byte_len" in nodes.columns:
        nodes = nodes.withColumnRenamed("byte_len", "size_bytes")
    nodes = nodes.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in PROPERTIES.items() if name not in nodes.columns])
    found = compile_pattern(asked.statement, nodes, edges, parameters)
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in asked.order]
    return found.orderBy(*keys, *[c for c in found.columns if c not in [k.lstrip("-") for k in asked.order]]).limit(asked.limit)


def groups(group: str | None = None) -> dict[str, str]:
    """Names and what they tell, of one group or all."""
    known = sorted({q.group for q in CATALOG.values()})
    if group is not None and group not in known:
        raise KeyError(f"unknown group {group}; known: {', '.join(known)}")
    return {name: q.about for name, q in CATALOG.items() if group in (None, q.group)}
