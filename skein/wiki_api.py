"""The knowledge operations as one object: bundles compiled into tables, read, searched, checked and written."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import authoring, generations, projection, search
from skein.operators import wiki as W
from skein.operators.authoring import AuthoringError, Page
from skein.operators.storage import materialize
from skein.sources import bundle, spool

TABLES = ("entries", "concepts", "headings", "citations", "links", "log", "directories", "documents", "grams", "diagnostics")
PROFILES = ("consume", "conformant", "recommended")
MEMORY, KINDS = "agent-memory", ("semantic", "episodic", "procedural")
METADATA = "struct<kind:string,status:string,owner:string,created_at:string,last_verified_at:string,verified_by:string,review_after:string,supersedes:array<string>,superseded_by:string,history:array<struct<from:string,to:string,actor:string,at:string,reason:string>>>"


class WikiError(ValueError):
    """A refused operation: a code and what was wrong."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Wiki:
    """Bundles (id to folder) and the folder of their compiled generations.

    Reads go to the published tables, which are compiled when there are none, and brought up to date when a write of this
    object came after them. Single answers are rows; lists are DataFrames.
    """

    spark: SparkSession
    root: str
    bundles: dict[str, str]
    stale: bool = field(default=False, init=False)

    # -- compiling ---------------------------------------------------------------------------------------

    @property
    def store(self) -> generations.Store:
        return generations.Store(self.root)

    def _files(self, bundle_id: str | None = None) -> DataFrame:
        if bundle_id is not None and bundle_id not in self.bundles:
            raise WikiError("bundle_not_found", "bundle is not configured for this wiki")
        chosen = self.bundles if bundle_id is None else {bundle_id: self.bundles[bundle_id]}
        if not chosen:
            raise WikiError("bundle_not_found", "no bundle is configured")
        return reduce(DataFrame.unionByName, [bundle.files(self.spark, folder, name) for name, folder in chosen.items()])

    def entries(self, bundle_id: str | None = None) -> DataFrame:
        """Parsed files, of one bundle or of all."""
        return bundle.parse(self._files(bundle_id))

    def build_projection(self) -> dict:
        """Publish the bundles' tables. ``cache`` is ``hit`` where nothing changed (and nothing is published), ``mixed``
        where the tables before were brought up to date from the changed files, and ``miss`` where all was compiled.
        """
        listing = ["bundle_id", "source_path", "absolute_path", "file_hash"]
        files = materialize(self._files().select(*listing[:3], F.sha2("content", 256).alias("file_hash")), "files")
        digest, now = generations.table_digest(files), self.store.current()
        if now and now["digest"] == digest:
            self.stale = False
            return now | {"cache": "hit", "changed": 0}
        if now is None or now.get("header") != {"version": projection.VERSION}:
            every = materialize(bundle.parse(self._files(), hashed=True), "entries")
            tables, done = projection.compiled(every), {"cache": "miss", "changed": files.count()}
            entry = self.store.publish(tables, digest=digest, header={"version": projection.VERSION})
        else:
            held = self.store.lease()
            try:
                old = {name: self.store.read(self.spark, name) for name in TABLES}
                before = old["entries"].select("bundle_id", "source_path", F.col("file_hash").alias("was"))
                both = files.join(before, ["bundle_id", "source_path"], "full")
                changed = materialize(both.where(~F.col("file_hash").eqNullSafe(F.col("was"))).select(*listing, "was"), "changed")
                contents = [block.join(F.broadcast(changed.where("file_hash is not null")), "absolute_path") for block in spool.listed(self.spark, changed.where("file_hash is not null"))]  # a block names at most spool.BLOCK files
                schema = f"bundle_id string, source_path string, {bundle.CONTENT}"
                there = reduce(DataFrame.unionByName, [c.select("bundle_id", "source_path", "content") for c in contents], self.spark.createDataFrame([], schema))
                fresh = materialize(bundle.parse(there, hashed=True), "entries")
                n, same = changed.count(), both.where("file_hash = was").isEmpty()
                entry = self.store.publish(projection.updated(old, fresh, changed), digest=digest, header=now["header"])
                done = {"cache": "miss" if same else "mixed", "changed": n}
            finally:
                self.store.release(held)
        self.stale = False
        return entry | done

    def table(self, name: str) -> DataFrame:
        if self.stale or self.store.current() is None:
            self.build_projection()
        return self.store.read(self.spark, name)

    # -- reading -----------------------------------------------------------------------------------------

    def health(self) -> dict:
        return {"ok": True, "projection_available": not self.stale and self.store.current() is not None}

    def list_bundles(self) -> DataFrame:
        return W.bundle_summary(self.table("concepts"), self.table("links")).orderBy("bundle_id")

    def get_directory(self, bundle_id: str, path: str = "") -> dict:
        found = self.table("directories").where((F.col("bundle_id") == bundle_id) & (F.col("path") == path)).first()
        if found is None:
            raise WikiError("concept_not_found", "directory was not found")
        return found.asDict(recursive=True)

    def get_concept(self, bundle_id: str, concept_id: str) -> dict:
        found = self.table("concepts").where((F.col("bundle_id") == bundle_id) & (F.col("concept_id") == concept_id)).first()
        if found is None:
            raise WikiError("concept_not_found", "concept was not found")
        return found.asDict(recursive=True)

    def search_concepts(self, text: str, bundle_id: str | None = None, concept_type: str | None = None, tags: list[str] | None = None, limit: int = 20) -> DataFrame:
        """At most 100 hits."""
        hits = search.weighted_search(self.table("documents"), text, min(limit, 100), bundle_id, concept_type, tags, self.table("grams"))
        return hits.select("bundle_id", "concept_id", "title", "type", "score", "matched_fields", "snippet")

    def get_backlinks(self, bundle_id: str, concept_id: str) -> DataFrame:
        """Links to the concept from others, and from itself by name: once each, in order."""
        self.get_concept(bundle_id, concept_id)
        good = self.table("links").where((F.col("bundle_id") == bundle_id) & (F.col("status") == "resolved") & (F.col("target_concept") == concept_id) & ~F.startswith(F.trim("href"), F.lit("#")))
        return good.select("source_id", "href", "fragment", "context").distinct().orderBy("source_id", "href", "context")

    def get_neighborhood(self, bundle_id: str, concept_id: str, limit: int = 20) -> DataFrame:
        """(direction, other, href, status): links out of and into a concept, 1 to 100 of each. One step whatever the depth."""
        limit = max(1, min(limit, 100))
        links = self.table("links").where((F.col("bundle_id") == bundle_id) & (F.col("source_id") == concept_id))
        out = links.select(F.lit("outgoing").alias("direction"), F.col("target_id").alias("other"), "href", "status").distinct().orderBy("href", "other").limit(limit)
        back = self.get_backlinks(bundle_id, concept_id).select(F.lit("backlink").alias("direction"), F.col("source_id").alias("other"), "href", F.lit("resolved").alias("status")).limit(limit)
        return out.unionByName(back)

    def get_recent_changes(self, bundle_id: str, path: str = "", limit: int = 20) -> DataFrame:
        """Log entries of a directory and all below it, newest first; 1 to 500 of them."""
        rows = W.roll_up(self.table("log").where(F.col("bundle_id") == bundle_id)).where(F.col("directory") == path)
        return rows.select("date", "scope", "category", "entry", "hrefs").orderBy(F.desc("date"), "scope", "category", "entry").limit(max(1, min(limit, 500)))

    def get_diagnostics(self, bundle_id: str) -> DataFrame:
        """Findings of the files as they are now, in order."""
        return W.conformance(self.entries(bundle_id)).orderBy("source_path", "line", "code", "severity")

    def check_links(self, bundle_id: str) -> DataFrame:
        """Broken and rejected links of the compiled bundle, in order."""
        return W.link_diagnostics(self.table("links").where(F.col("bundle_id") == bundle_id)).orderBy("source_id", "href")

    def validate_bundle(self, bundle_id: str, profile: str = "conformant") -> tuple[bool, DataFrame]:
        if profile not in PROFILES:
            raise WikiError("invalid_request", f"profile must be one of {', '.join(PROFILES)}")
        found = self.get_diagnostics(bundle_id)
        verdict = W.acceptance(self.spark.createDataFrame([(bundle_id,)], "bundle_id string"), found).first()
        return verdict[profile], found

    def routes(self) -> DataFrame:
        return W.routes(self.table("concepts"))

    # -- writing -----------------------------------------------------------------------------------------

    def _folder(self, bundle_id: str) -> str:
        if bundle_id not in self.bundles:
            raise WikiError("bundle_not_found", "bundle was not found")
        return self.bundles[bundle_id]

    def create_bundle(self, bundle_id: str, folder: str, version: str, title: str | None = None, body: str = "") -> dict:
        if bundle_id in self.bundles:
            raise AuthoringError("bundle_exists", bundle_id)
        done = authoring.create_bundle(self.spark, folder, bundle_id, version, title, body)
        self.bundles[bundle_id], self.stale = folder, True
        return done

    def create_page(self, bundle_id: str, path: str, page: Page, body: str | None = None) -> dict:
        done = authoring.create_page(self.spark, self._folder(bundle_id), path, page, body)
        self.stale = True
        return done

    def populate_page(self, bundle_id: str, path: str, page: Page, body: str, expected_hash: str | None = None) -> dict:
        done = authoring.populate_page(self.spark, self._folder(bundle_id), path, page, body, expected_hash)
        self.stale = True
        return done

    # -- memory ------------------------------------------------------------------------------------------

    def memories(self) -> DataFrame:
        """Records of the agents' memories: pages of their type whose path agrees with their kind."""
        data = F.from_json(F.get_json_object("extensions", "$.agent_memory"), METADATA)
        rows = self.table("concepts").where(F.col("type") == MEMORY).withColumn("data", data)
        rows = rows.withColumn("memory_id", F.substring_index("concept_id", "/", -1)).where(F.col("concept_id") == F.concat(F.lit("memory/"), "data.kind", F.lit("/"), "memory_id"))
        return rows.select("bundle_id", "memory_id", "concept_id", "title", "data.*").withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>")))

    def record_memory(self, bundle_id: str, memory_id: str, kind: str, title: str, body: str, owner: str, created_at: str, sources: list[dict], description: str | None = None, tags: list[str] = (), review_after: str | None = None, supersedes: list[str] = ()) -> dict:
        """A new memory, as a candidate; its id must be new in the bundle whatever its kind."""
        _memory_id(memory_id)
        if kind not in KINDS:
            raise WikiError("invalid_memory_request", f"kind must be one of {', '.join(KINDS)}")
        for name, value in (("title", title), ("owner", owner), ("created_at", created_at)):
            if not value.strip():
                raise WikiError("invalid_memory_request", f"{name} must not be empty")
        if not sources or not all(s.get("kind", "").strip() and s.get("reference", "").strip() for s in sources):
            raise WikiError("invalid_memory_request", "sources must not be empty, nor their kind and reference")
        self._folder(bundle_id)
        last = F.substring_index("concept_id", "/", -1)
        if self.table("concepts").where((F.col("bundle_id") == bundle_id) & (F.col("type") == MEMORY) & (last == memory_id)).limit(1).count():
            raise WikiError("memory_exists", "memory identity already exists in the bundle")
        data = {"version": 1, "kind": kind, "scope": "repository", "status": "candidate", "owner": owner, "created_at": created_at, "supersedes": list(supersedes), "sources": [dict(s) for s in sources], "history": []}
        if review_after:
            data["review_after"] = review_after
        done = self.create_page(bundle_id, f"memory/{kind}/{memory_id}.md", Page(MEMORY, title, description, None, list(tags), created_at, {"agent_memory": data}), body)
        return done | {"memory_id": memory_id, "kind": kind, "status": "candidate"}

    def recall_memory(self, bundle_id: str, text: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
        """Active memories that match, best first; 20 at most."""
        self._folder(bundle_id)
        active = self.memories().where((F.col("bundle_id") == bundle_id) & (F.col("status") == "active"))
        if kinds:
            active = active.where(F.col("kind").isin(*kinds))
        documents = self.table("documents").join(active.select("bundle_id", "concept_id"), ["bundle_id", "concept_id"], "left_semi")
        limit = min(limit or 20, 20)
        hits = search.weighted_search(documents, text, limit, bundle_id, MEMORY)
        return W.recall(hits, active, kinds, limit)

    def transition_memory(self, bundle_id: str, memory_id: str, to_status: str, actor: str, at: str, reason: str, replacement_id: str | None = None) -> dict:
        """Change a memory's status and write its page back; a page changed meanwhile is a conflict."""
        _memory_id(memory_id)
        request = self.spark.createDataFrame([(bundle_id, memory_id, to_status, actor, at, reason, replacement_id)], "bundle_id string, memory_id string, to_status string, actor string, at string, reason string, replacement_id string")
        verdict = W.transitions(request, self.memories()).first().asDict(recursive=True)
        if verdict["error"]:
            raise WikiError("memory_not_found" if verdict["from_status"] is None and "not found" in verdict["error"] else "invalid_memory_transition", verdict["error"])
        kind = self.memories().where((F.col("bundle_id") == bundle_id) & (F.col("memory_id") == memory_id)).first()["kind"]
        path = f"memory/{kind}/{memory_id}.md"
        content = authoring.Files(self.spark, self._folder(bundle_id)).read(path)
        front, body = authoring.parse_document(content)
        new = {k: verdict[k] for k in ("status", "last_verified_at", "verified_by", "superseded_by", "history")}
        data = {k: v for k, v in (front["agent_memory"] | new).items() if v is not None}
        page = Page(front["type"], front.get("title"), front.get("description"), front.get("resource"), front.get("tags") or [], str(front["timestamp"]) if front.get("timestamp") else None, {"agent_memory": data})
        self.populate_page(bundle_id, path, page, body, authoring.content_hash(content))
        return new | {"memory_id": memory_id, "kind": kind}


def _memory_id(memory_id: str) -> None:
    if not memory_id or not all(c.isascii() and (c.isalnum() or c in "-_") for c in memory_id):
        raise WikiError("invalid_memory_request", "memory_id must contain only ASCII letters, digits, hyphens, or underscores")
