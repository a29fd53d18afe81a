"""The published tables of knowledge bundles: compiled whole, or brought up to date from a few changed files.

A page's own rows (concept, headings, citations, links as written, search document) follow from its file alone. What
follows from several files is found from the change: links of other pages whose target is a changed page or a
directory above one are resolved again, directories above changed pages and at changed indexes are listed again.
Everything else is taken over from the generation before. Diagnostics read no text and are made anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import ancestors, extension_terms, parent
from skein.operators import search
from skein.operators import wiki as W
from skein.operators.storage import materialize
from skein.sources import bundle, markdown

KEYS = ["bundle_id", "concept_id"]
#: Goes up when unchanged files would give other tables.
VERSION = 2
LINK = [*KEYS[:1], "source_id", "position", "line", "context", "href"]
Tables = dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]


def concepts_of(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts with the first of repeated ids kept, and warnings about the others."""
    own = entries.where("kind = 'concept'").withColumn("concept_id", bundle.concept_id(F.col("source_path")))
    kept, again = W.first_concepts(own)
    return kept.drop("kind", "key_lines", "diagnostics", "file_hash"), again


def _texts(concepts: DataFrame) -> DataFrame:
    return concepts.select(*KEYS, F.col("body_markdown").alias("text"))


def written_links(concepts: DataFrame) -> DataFrame:
    return markdown.links(_texts(concepts).withColumnRenamed("concept_id", "source_id"), ["bundle_id", "source_id"]).select(*LINK)


def documents_of(concepts: DataFrame, headings: DataFrame, citations: DataFrame) -> DataFrame:
    shown = lambda df, name, of: df.groupBy(*KEYS).agg(F.array_sort(F.collect_set(of)).alias(name))  # noqa: E731  a document's own
    rows = concepts.select(*KEYS, "type", "title", "description", "tags", extension_terms(F.col("extensions")).alias("extensions"), F.col("body_markdown").alias("body"))
    rows = rows.join(shown(headings, "headings", "heading"), KEYS, "left").join(shown(citations, "citations", "citation"), KEYS, "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("title", F.coalesce("title", "concept_id")).withColumns({c: F.coalesce(c, none) for c in ("headings", "citations")})


def logs_of(entries: DataFrame) -> DataFrame:
    logs = entries.where("kind = 'log'").select("bundle_id", parent(F.col("source_path")).alias("scope"), F.col("body_markdown").alias("text"))
    return markdown.log_entries(logs, ["bundle_id", "scope"]).where("date is not null")


def directories_of(concepts: DataFrame, entries: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Listings of all directories, or of those of ``at`` (bundle_id, path): then from the concepts in them and one below each of their children."""
    names, tree_of = concepts.select(*KEYS, "title"), concepts
    if at is not None:
        own = names.withColumn("path", parent(F.col("concept_id"))).join(at, ["bundle_id", "path"], "left_semi").select(*KEYS)
        below = names.select(*KEYS, F.explode(ancestors(parent(F.col("concept_id")))).alias("child")).where("child <> ''").withColumn("path", parent(F.col("child")))
        below = below.join(at, ["bundle_id", "path"], "left_semi").groupBy("bundle_id", "child").agg(F.min("concept_id").alias("concept_id")).select(*KEYS)
        tree_of = own.unionByName(below).distinct()
    tree = W.hierarchy(tree_of)
    if at is not None:
        tree = tree.join(at, ["bundle_id", "path"], "left_semi")
    authored = entries.where("kind = 'index'").select("bundle_id", parent(F.col("source_path")).alias("path"), F.col("body_markdown").alias("authored"), "title")
    rows = tree.join(W.directory_body(tree, names), ["bundle_id", "path"]).join(authored, ["bundle_id", "path"], "left")
    source = F.when(F.col("authored").isNull(), "synthetic").otherwise("authored")
    return rows.select("bundle_id", "path", "title", "child_directories", "concepts", source.alias("index_source"), F.coalesce("authored", "body").alias("body_markdown"))


def _slugs(headings: DataFrame) -> DataFrame:
    return headings.select(*KEYS, "slug")


def compiled(entries: DataFrame) -> Tables:
    """All tables from all entries."""
    concepts, again = concepts_of(entries)
    return {
        "entries": entries,
        "concepts": concepts,
        "headings": lambda t: markdown.headings(_texts(t["concepts"]), KEYS),
        "citations": lambda t: markdown.citations(_texts(t["concepts"]), KEYS),
        "links": lambda t: W.resolve_links(written_links(t["concepts"]), t["concepts"], _slugs(t["headings"])),
        "log": logs_of(entries),
        "directories": lambda t: directories_of(t["concepts"], t["entries"]),
        "documents": lambda t: documents_of(t["concepts"], t["headings"], t["citations"]),
        "grams": lambda t: search.clustered(search.grams_of(t["documents"])),
        "diagnostics": W.conformance(entries).unionByName(again),
    }


def link_target() -> Column:
    """The path of a link's target, whatever is there; routes begin with ``bundle:``, the bundle and a colon."""
    return F.regexp_replace(F.expr("substring(target_id, length(bundle_id) + 9)"), "^(?:concept|directory):", "")


def updated(old: dict[str, DataFrame], fresh: DataFrame, changed: DataFrame) -> Tables:
    """The tables after ``changed`` files (bundle_id, source_path), of which ``fresh`` are the entries that there are now."""
    changed = materialize(changed.select("bundle_id", "source_path").distinct(), "changed")
    kind = bundle.entry_kind(F.col("source_path"))
    pages = materialize(changed.where(kind == "concept").select("bundle_id", bundle.concept_id(F.col("source_path")).alias("concept_id")).distinct(), "pages")
    above = pages.select("bundle_id", F.explode(ancestors(parent(F.col("concept_id")))).alias("path"))
    at = materialize(above.unionByName(changed.where(kind == "index").select("bundle_id", parent(F.col("source_path")).alias("path"))).distinct(), "directories")
    scopes = changed.where(kind == "log").select("bundle_id", parent(F.col("source_path")).alias("scope"))
    spots = materialize(pages.select("bundle_id", F.col("concept_id").alias("target")).unionByName(above.select("bundle_id", F.col("path").alias("target"))).distinct(), "spots")
    sources = pages.withColumnRenamed("concept_id", "source_id")

    entries = old["entries"].join(changed, ["bundle_id", "source_path"], "left_anti").unionByName(fresh)

    def with_new(name: str, made: DataFrame, keys: DataFrame) -> DataFrame:
        return old[name].join(keys, keys.columns, "left_anti").unionByName(made)

    def own(t: dict) -> DataFrame:
        """The changed pages that there are now."""
        return t["concepts"].join(pages, KEYS, "left_semi")

    def concepts(t: dict) -> DataFrame:
        again = t["entries"].where(F.col("kind") == "concept").withColumn("concept_id", bundle.concept_id(F.col("source_path"))).join(pages, KEYS, "left_semi").drop("concept_id")
        return with_new("concepts", concepts_of(again)[0], pages)

    def links(t: dict) -> DataFrame:
        others = old["links"].join(sources, sources.columns, "left_anti").withColumn("target", link_target())
        moved = others.join(spots, ["bundle_id", "target"], "left_semi").select(*LINK)
        kept = others.join(spots, ["bundle_id", "target"], "left_anti").drop("target")  # no target: outside, or refused
        return kept.unionByName(W.resolve_links(written_links(own(t)).unionByName(moved), t["concepts"], _slugs(t["headings"])))

    part = lambda t, name: t[name].join(pages, KEYS, "left_semi")
    return {
        "entries": entries,
        "concepts": concepts,
        "headings": lambda t: with_new("headings", markdown.headings(_texts(own(t)), KEYS), pages),
        "citations": lambda t: with_new("citations", markdown.citations(_texts(own(t)), KEYS), pages),
        "links": links,
        "log": lambda t: with_new("log", logs_of(t["entries"].join(changed, ["bundle_id", "source_path"], "left_semi")), scopes),
        "directories": lambda t: with_new("directories", directories_of(t["concepts"], t["entries"], at), at),
        "documents": lambda t: with_new("documents", documents_of(own(t), part(t, "headings"), part(t, "citations")), pages),
        "grams": lambda t: search.clustered(with_new("grams", search.grams_of(part(t, "documents")), pages)),
        "diagnostics": lambda t: W.conformance(t["entries"]).unionByName(concepts_of(t["entries"])[1]),
    }
