"""The operations as one object: build, plan, search, context, query, catalogs, health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.ontology import EDGE_TYPES, NODE_TYPES, PROFILES, SYNTAX_RELATIONS, context_relations
from skein.operators import generations, graph, manifest, search
from skein.operators.artifacts import Artifacts, refreshed
from skein.operators.storage import Files, materialize, new_path
from skein.plans import named
from skein.plans.patterns import run_pattern
from skein.sources import code, scan, spool

LAYERS = ("semantic", "syntax", "hybrid")
#: Beyond so many batches of artifacts they are rewritten as one.
MOST_BATCHES = 40


class ApiError(ValueError):
    """A refused request: a code and what was wrong."""

    def __init__(self, code_: str, message: str):
        super().__init__(message)
        self.code = code_


@dataclass
class Graph:
    """A published code graph under ``root`` (a folder of generations)."""

    spark: SparkSession
    root: str
    parsers: dict[str, Callable[[str, str], list[dict]]] = field(default_factory=dict)

    @property
    def store(self) -> generations.Store:
        return generations.Store(self.root)

    def nodes(self) -> DataFrame:
        return self.store.read(self.spark, "nodes")

    def edges(self) -> DataFrame:
        return self.store.read(self.spark, "edges")

    def plan(self, source: str, ignore: list[str] = (), exclude: list[str] = (), include: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """What a build would do: (path, status), and one row of counts."""
        scanned = scan.scan(self.spark, source, include, ignore, exclude).drop("content")
        now, entry = scanned.where("status = 'source'"), self.store.current()
        old = self.store.read(self.spark, "manifest") if entry else None
        changes = manifest.diff(now, old, force=entry is not None and entry.get("header") != self.header())
        return changes, manifest.summary(scanned, changes)

    def header(self) -> dict:
        """What a manifest's rows and the artifacts hold for, beside the files."""
        return code.versions(("python", *self.parsers))

    def materialize(self, source: str, ignore: list[str] = (), exclude: list[str] = (), include: list[str] = (), repository: str = "repository") -> dict:
        """Scan, parse what changed, merge, index, validate and publish; an unchanged source publishes nothing.

        Files are hashed once. Those without a usable artifact are copied to a spool, which must hold what was hashed, and
        are parsed from there; rows of all others come from the artifacts of earlier builds.
        """
        header = self.header()
        scanned = scan.scan(self.spark, source, include, ignore, exclude).where("status = 'source'")
        files = scanned.select("path", "absolute_path", "content_hash", "language").withColumn("artifact_key", manifest.artifact_key(header, "path", "content_hash", "language"))
        files = materialize(files, "files")
        listed = files.select("path", "content_hash", "language", "artifact_key")
        digest, now = generations.table_digest(listed), self.store.current()
        if now and now["digest"] == digest:
            return now | {"cache": "hit"}
        artifacts = Artifacts(self.spark, f"{self.root}/artifacts", {"nodes": code.NODE_ROWS, "edges": code.EDGE_ROWS})
        folder = new_path(self.spark, "spool")

        def make(missing: DataFrame) -> tuple[DataFrame, DataFrame]:
            everything = lambda: scan.scan(self.spark, source, include, ignore, exclude).where("status = 'source'").select("path", "content")
            contents = spool.spool(self.spark, missing, folder, everything, prefer_whole=now is None)
            return code.graph_rows(code.parse_files(contents, self.parsers), missing.select("path", "artifact_key"))

        parsed = files.where(F.col("language").isin("markdown", "python", *self.parsers))
        node_rows, edge_rows, counts = refreshed(artifacts, parsed, make)
        nodes, edges = code.merge_graph(node_rows, edge_rows, listed, repository, source)
        tables = {"nodes": nodes, "edges": edges, "manifest": listed, **search.index_tables(lambda written: self.documents(written["nodes"]))}
        entry = self.store.publish(tables, digest=digest, validate=generations.check_bundle, partition_by={"nodes": "node_type", "edges": "edge_type"}, header=header, verified=search.PARTS)
        artifacts.collect(parsed)
        if len(artifacts.batches) > MOST_BATCHES:
            artifacts.compact(parsed)
        Files(self.spark, folder).delete("")
        return entry | counts

    def diagnostics(self, source: str, ignore: list[str] = (), exclude: list[str] = (), include: list[str] = ()) -> DataFrame:
        """(path, message) of files that a build leaves out, or knows by their path only."""
        scanned = scan.scan(self.spark, source, include, ignore, exclude).drop("content")
        return scan.diagnostics(scanned).unionByName(code.unparsed(scanned.where("status = 'source'"), ("python", *self.parsers)))

    def health(self, verify: bool = False) -> dict:
        """Counts of the current generation; with ``verify`` also which files of its index are damaged, 100 at most."""
        entry = self.store.current()
        if entry is None:
            return {"ready": False}
        out = {"ready": True, "generation": entry["generation"]} | graph.counts(self.nodes(), self.edges()).first().asDict()
        if verify:
            damaged = {r["file"]: r["problem"] for r in self.store.damage(self.spark).orderBy("file").limit(100).collect()}
            out |= {"damaged": damaged, "ready": not damaged}
        return out

    @staticmethod
    def documents(nodes: DataFrame) -> DataFrame:
        """Nodes as search documents of two layers."""
        layer = F.when(F.col("node_type") == "SyntaxCapture", "syntax").otherwise("semantic")
        return nodes.select("id", layer.alias("layer"), F.when(layer == "syntax", 1).otherwise(0).alias("index_order"), search.indexed_text(["label", "qualified_name", "path", "summary"]).alias("text"))

    def search(self, query: str, layer: str = "semantic", limit: int = 3) -> DataFrame:
        if not query.strip():
            raise ApiError("missing_query", "a search needs a query")
        if layer not in LAYERS:
            raise ApiError("invalid_graph_layer", f"layer must be one of {', '.join(LAYERS)}")
        if not 1 <= limit <= 1000:
            raise ApiError("invalid_limit", "limit must be from 1 to 1000")
        index = search.Index(*(self.store.read(self.spark, part) for part in search.PARTS))
        return search.search(index, self.nodes(), query, layer, limit)

    def context(self, node_id: str, profile: str = "brief", layer: str = "semantic", limit: int = 3, max_depth: int | None = None) -> DataFrame:
        if profile not in PROFILES:
            raise ApiError("context_execution_failed", f"unknown context profile: {profile}")
        if layer not in LAYERS:
            raise ApiError("invalid_graph_layer", f"layer must be one of {', '.join(LAYERS)}")
        depth = max_depth if max_depth is not None else 1 if layer == "syntax" else PROFILES[profile][1]
        return graph.context(self.nodes(), self.edges(), node_id, context_relations(profile, layer), limit, depth, syntax_first=layer != "semantic")

    def search_with_context(self, query: str, layer: str = "semantic", limit: int = 3, profile: str = "brief", context_limit: int = 3, max_depth: int | None = None) -> list[dict]:
        """``search``'s hits, 50 at most, each with ``context``: its rows of ``context``, all found together.

        Where contexts can't be read, hits come without them and ``state`` is ``degraded`` instead of ``ready``.
        """
        if profile not in PROFILES:
            raise ApiError("context_execution_failed", f"unknown context profile: {profile}")
        hits = [r.asDict(recursive=True) for r in self.search(query, layer, min(limit, 50)).orderBy("position").collect()]
        depth = max_depth if max_depth is not None else 1 if layer == "syntax" else PROFILES[profile][1]
        around: dict[str, list[dict]] = {}
        state = "ready"
        try:
            found = graph.contexts(self.nodes(), self.edges(), [h["id"] for h in hits], context_relations(profile, layer), context_limit, depth, syntax_first=layer != "semantic")
            for r in found.orderBy("start", "position").collect():
                around.setdefault(r["start"], []).append({k: v for k, v in r.asDict().items() if k != "start"})
        except PySparkException:
            state, around = "degraded", {}
        return [h | {"context": around.get(h["id"], []), "state": state} for h in hits]

    def query(self, statement: str, parameters: dict | None = None, limit: int = 100) -> dict:
        return run_pattern(statement, self.nodes(), self.edges(), parameters, limit)

    def ask(self, question: str, /, **parameters: str) -> DataFrame:
        return named.ask(question, self.nodes(), self.edges(), **parameters)

    @staticmethod
    def catalog(group: str | None = None) -> dict[str, str]:
        return named.groups(group)

    @staticmethod
    def schema() -> dict:
        return {"node_types": list(NODE_TYPES), "edge_types": list(EDGE_TYPES), "profiles": {k: v[0] for k, v in PROFILES.items()}, "syntax_relations": SYNTAX_RELATIONS}
