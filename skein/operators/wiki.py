"""Knowledge bundles compiled: links, backlinks, directories, logs, facets, conformance, memory, invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import ancestors, link_kind, normalize_path, parent, percent_encode, slug


def concept_route(bundle: Column, concept: Column) -> Column:
    return F.concat(F.lit("bundle:"), bundle, F.lit(":concept:"), concept)


def directory_route(bundle: Column, path: Column) -> Column:
    return F.concat(F.lit("bundle:"), bundle, F.lit(":directory:"), path)


def directories(concepts: DataFrame) -> DataFrame:
    """(bundle_id, path) of every directory that holds a concept or a directory, the root included."""
    return concepts.select("bundle_id", F.explode(ancestors(parent(F.col("concept_id")))).alias("path")).distinct()


def hierarchy(concepts: DataFrame) -> DataFrame:
    """Per directory its sorted child directories and concepts."""
    dirs = directories(concepts)
    children = dirs.where("path <> ''").groupBy("bundle_id", parent(F.col("path")).alias("path")).agg(F.array_sort(F.collect_set(F.col("path"))).alias("child_directories"))
    own = concepts.groupBy("bundle_id", parent(F.col("concept_id")).alias("path")).agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"))
    none = F.array().cast("array<string>")
    out = dirs.join(children, ["bundle_id", "path"], "left").join(own, ["bundle_id", "path"], "left")
    return out.select("bundle_id", "path", F.coalesce("child_directories", none).alias("child_directories"), F.coalesce("concepts", none).alias("concepts"))


def first_concepts(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts with the first of repeated ids kept, and a warning for each of the others."""
    nth = F.row_number().over(Window.partitionBy("bundle_id", "concept_id").orderBy("source_path"))
    rows = concepts.withColumn("nth", nth)
    again = rows.where("nth > 1").select("bundle_id", "source_path", F.lit("warning").alias("severity"), F.lit("duplicate_concept_id").alias("code"), F.lit(None).cast("int").alias("line"))
    return rows.where("nth = 1").drop("nth"), again


def resolve_links(links: DataFrame, concepts: DataFrame, fragments: DataFrame, directory_fragments: DataFrame | None = None) -> DataFrame:
    """Status and target of every link: external, rejected, resolved or broken.

    links: bundle_id, source_id, href. concepts: bundle_id, concept_id. fragments: bundle_id, concept_id, slug.
    Targets are normalised as expressions; three left joins look up concept, directory and fragment.
    """
    href = F.trim("href")
    kind = link_kind(F.col("href"))
    path, raw = F.substring_index(href, "#", 1), F.when(F.instr(href, "#") > 0, F.expr("substring(trim(href), instr(trim(href), '#') + 1)"))
    base = parent(F.col("source_id"))
    rows = links.withColumns({"kind": kind, "path": path, "frag": F.when(F.coalesce(raw, F.lit("")) != "", slug(raw))})
    norm = F.when(F.col("kind") == "internal", normalize_path(base, F.col("path")))
    rows = rows.withColumn("norm", norm)
    reserved = F.col("norm").rlike(r"(^|/)(index|log)\.md$")
    own = F.col("path") == ""
    target = F.when(own, F.col("source_id")).when(reserved, parent(F.col("norm"))).otherwise(F.regexp_replace("norm", r"\.md$", ""))
    rows = rows.withColumns({"self": own, "reserved": reserved, "target": target})
    c = concepts.select("bundle_id", F.col("concept_id").alias("target"), F.lit(True).alias("is_concept")).distinct()
    d = directories(concepts).select("bundle_id", F.col("path").alias("target"), F.lit(True).alias("is_directory"))
    rows = rows.join(c, ["bundle_id", "target"], "left").join(d, ["bundle_id", "target"], "left")
    markdown = F.col("norm").rlike(r"\.md$") & ~F.col("reserved")
    what = (
        F.when(F.col("kind") != "internal", F.lit(None))
        .when(F.col("self"), "concept")
        .when(F.col("norm").isNull(), "climbs")
        .when((F.col("norm") == "") | F.col("reserved"), "directory")
        .when(markdown, F.when(F.col("is_concept"), "concept").otherwise("no concept"))
        .when(F.col("is_concept"), "concept")
        .when(F.col("is_directory"), "directory")
        .when(F.col("path").endswith("/"), "no directory")
        .otherwise("no concept")
    )
    rows = rows.withColumn("what", what)
    f = fragments.select("bundle_id", F.col("concept_id").alias("target"), F.col("slug").alias("frag"), F.lit("concept").alias("what"))
    if directory_fragments is not None:
        f = f.unionByName(directory_fragments.select("bundle_id", F.col("path").alias("target"), F.col("slug").alias("frag"), F.lit("directory").alias("what")))
    rows = rows.join(f.distinct().withColumn("has", F.lit(True)), ["bundle_id", "target", "frag", "what"], "left")
    status = (
        F.when(F.col("kind") == "external", "external")
        .when((F.col("kind") == "rejected") | (F.col("what") == "climbs"), "rejected")
        .when(F.col("what").isin("no concept", "no directory"), "broken")
        .when(F.col("frag").isNotNull() & F.col("has").isNull(), "broken")
        .otherwise("resolved")
    )
    route = F.when(F.col("what").isin("concept", "no concept"), concept_route(F.col("bundle_id"), F.col("target"))).when(F.col("what").isin("directory", "no directory"), directory_route(F.col("bundle_id"), F.col("target")))
    return rows.select(*links.columns, status.alias("status"), route.alias("target_id"), F.when(F.col("what") == "concept", F.col("target")).alias("target_concept"), F.col("frag").alias("fragment"))


def link_diagnostics(resolved: DataFrame) -> DataFrame:
    code = F.when(F.col("status") == "broken", "broken_link").when(F.col("status") == "rejected", "rejected_link")
    return resolved.where(F.col("status").isin("broken", "rejected")).select("bundle_id", "source_id", F.lit("warning").alias("severity"), code.alias("code"), "href")


def backlinks(resolved: DataFrame) -> DataFrame:
    """(bundle_id, concept_id, backlinks): who links to a concept, sorted and once each; not itself by a fragment alone."""
    good = resolved.where("status = 'resolved' and target_concept is not null")
    return good.groupBy("bundle_id", F.col("target_concept").alias("concept_id")).agg(F.array_sort(F.collect_set("source_id")).alias("backlinks"))


def roll_up(entries: DataFrame) -> DataFrame:
    """Log entries (bundle_id, scope, ...) under their own directory and each one above it."""
    return entries.select(F.explode(ancestors(F.col("scope"))).alias("directory"), *entries.columns)


def facets(concepts: DataFrame) -> DataFrame:
    """(bundle_id, facet, value, n) by type and by tag."""
    types = concepts.select("bundle_id", "concept_id", F.lit("type").alias("facet"), F.col("type").alias("value"))
    tags = concepts.select("bundle_id", "concept_id", F.lit("tag").alias("facet"), F.explode(F.array_distinct("tags")).alias("value"))
    return types.unionByName(tags).where("value is not null").groupBy("bundle_id", "facet", "value").agg(F.count("*").alias("n"))


def recent_changes(concepts: DataFrame, entries: DataFrame, limit: int = 20) -> DataFrame:
    """Timestamps and log entries, newest first; 1 to 500 of them."""
    a = concepts.where("timestamp is not null").select("bundle_id", F.col("timestamp").alias("date"), F.lit("concept").alias("kind"), F.col("concept_id").alias("what"))
    b = entries.select("bundle_id", "date", F.lit("log").alias("kind"), F.col("entry").alias("what"))
    return a.unionByName(b).orderBy(F.desc("date"), "bundle_id", "kind", "what").limit(max(1, min(limit, 500)))


def bundle_summary(concepts: DataFrame, resolved: DataFrame) -> DataFrame:
    a = concepts.groupBy("bundle_id").agg(F.count("*").alias("concepts"), F.count_distinct("type").alias("types"))
    b = resolved.groupBy("bundle_id").agg(F.count("*").alias("links"), F.count_if(F.col("status") == "broken").alias("broken"))
    return a.join(b, "bundle_id", "left").fillna(0, ["links", "broken"])


def conformance(entries: DataFrame) -> DataFrame:
    """Diagnostics (bundle_id, source_path, severity, code, line) of the conformance rules, as one pass of
    conditional rows over the entries and one over the bundles."""
    at = lambda key: F.try_element_at("key_lines", F.lit(key))
    concept, front, parsed = F.col("kind") == "concept", F.col("has_frontmatter"), F.col("parsed")
    root = (F.col("kind") == "index") & (F.col("source_path") == "index.md")
    first = F.array_min(F.map_values("key_lines"))
    memory = F.regexp_like(F.col("source_path"), F.concat(F.lit("^memory/"), F.get_json_object("extensions", "$.agent_memory.kind"), F.lit("/[A-Za-z0-9_-]+\\.md$")))
    rule = lambda test, severity, code, line: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), line.cast("int").alias("line")))
    one = F.lit(1)
    found = F.array_compact(
        F.array(
            rule(concept & ~front, "error", "missing_frontmatter", one),
            rule(concept & parsed & F.col("type").isNull(), "error", "missing_type", F.coalesce(at("type"), one)),
            rule(concept & parsed & F.col("okf_version").isNotNull(), "error", "invalid_reserved_metadata", at("okf_version")),
            rule((F.col("kind") == "index") & ~root & front, "error", "reserved_frontmatter", first),
            rule((F.col("kind") == "log") & front, "error", "reserved_frontmatter", first),
            rule(concept & parsed & F.col("title").isNull(), "warning", "recommended_title_missing", F.coalesce(at("type"), one)),
            rule(concept & parsed & F.col("description").isNull(), "warning", "recommended_description_missing", F.coalesce(at("type"), one)),
            rule(concept & parsed & (F.col("type") == "agent-memory") & ~F.coalesce(memory, F.lit(False)), "warning", "recommended_agent_memory_invalid", F.coalesce(at("agent_memory"), one)),
            rule(root & F.col("okf_version").isNull(), "warning", "recommended_okf_version_missing", one),
        )
    )
    rules = entries.select("bundle_id", "source_path", F.inline(found))
    parse = entries.select("bundle_id", "source_path", F.explode("diagnostics").alias("d")).select("bundle_id", "source_path", "d.severity", "d.code", "d.line")
    rootless = entries.groupBy("bundle_id").agg(F.max(root.cast("int")).alias("r")).where("r = 0").select("bundle_id", F.lit("index.md").alias("source_path"), F.lit("warning").alias("severity"), F.lit("recommended_okf_version_missing").alias("code"), one.cast("int").alias("line"))
    return rules.unionByName(parse).unionByName(rootless)


def acceptance(bundles: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per bundle whether it passes the profiles consume, conformant and recommended."""
    worst = diagnostics.groupBy("bundle_id").agg(F.every(F.col("severity") != "error").alias("conformant"), F.every(F.col("severity") == "info").alias("recommended"))
    yes = F.lit(True)
    return bundles.select("bundle_id").distinct().join(worst, "bundle_id", "left").select("bundle_id", yes.alias("consume"), F.coalesce("conformant", yes).alias("conformant"), F.coalesce("recommended", yes).alias("recommended"))


#: Allowed changes of a memory's status (fixed values).
TRANSITIONS = (("candidate", "active"), ("candidate", "quarantined"), ("active", "superseded"), ("active", "quarantined"), ("quarantined", "candidate"))


def transitions(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Each request (bundle_id, memory_id, to_status, actor, at, reason, replacement_id) with its verdict.

    records: bundle_id, memory_id, status, supersedes, and if they have them last_verified_at, verified_by,
    superseded_by and history. A supersession needs an active replacement in the same bundle that says what it
    supersedes. ``error`` is null where the change is allowed; then the record's new state follows from it:
    activation verifies, a return to candidate clears the verification, and history grows by one entry.
    """
    string = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    entry = "array<struct<from:string,to:string,actor:string,at:string,reason:string>>"
    past = F.coalesce("history", F.array().cast(entry)) if "history" in records.columns else F.array().cast(entry)
    now = records.select("bundle_id", "memory_id", F.col("status").alias("from_status"), string("last_verified_at").alias("old_at"), string("verified_by").alias("old_by"), string("superseded_by").alias("old_up"), past.alias("past"))
    new = records.select("bundle_id", F.col("memory_id").alias("replacement_id"), F.col("status").alias("new_status"), F.col("supersedes").alias("new_supersedes"))
    rows = requests.join(now, ["bundle_id", "memory_id"], "left").join(new, ["bundle_id", "replacement_id"], "left")
    allowed = None
    for a, b in TRANSITIONS:
        test = (F.col("from_status") == a) & (F.col("to_status") == b)
        allowed = test if allowed is None else allowed | test
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    to = F.col("to_status")
    up = to == "superseded"
    error = (
        F.when(blank("actor"), "actor must not be empty")
        .when(blank("at"), "transitioned_at must not be empty")
        .when(blank("reason"), "reason must not be empty")
        .when(~up & F.col("replacement_id").isNotNull(), "replacement_id is only valid for supersession")
        .when(F.col("from_status").isNull(), "memory not found")
        .when(~allowed, F.concat(F.lit("transition from "), F.initcap("from_status"), F.lit(" to "), F.initcap(to), F.lit(" is not allowed")))
        .when(up & F.col("replacement_id").isNull(), "supersession requires replacement_id")
        .when(up & F.col("new_status").isNull(), "supersession replacement was not found")
        .when(up & (F.col("new_status") != "active"), "supersession replacement must be active")
        .when(up & ~F.array_contains("new_supersedes", F.col("memory_id")), "replacement must declare the memory it supersedes")
    )
    ok = F.col("error").isNull()
    rows = rows.withColumn("error", error)
    verified = lambda old, given: F.when(ok & (to == "active"), F.col(given)).when(ok & (to == "candidate"), F.lit(None)).otherwise(F.col(old))
    superseded = F.when(ok & up, F.col("replacement_id")).when(ok & to.isin("active", "candidate"), F.lit(None)).otherwise(F.col("old_up"))
    step = F.array(F.struct(F.col("from_status").alias("from"), to.alias("to"), F.col("actor").alias("actor"), F.col("at").alias("at"), F.col("reason").alias("reason"))).cast(entry)
    return rows.select(*requests.columns, "from_status", "error", F.when(ok, to).otherwise(F.col("from_status")).alias("status"), verified("old_at", "at").alias("last_verified_at"), verified("old_by", "actor").alias("verified_by"), superseded.alias("superseded_by"), F.when(ok, F.concat("past", step)).otherwise(F.col("past")).alias("history"))


def recall(hits: DataFrame, records: DataFrame, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Search hits that are active memories, best first; 20 at most."""
    active = records.where("status = 'active'")
    if kinds:
        active = active.where(F.col("kind").isin(*kinds))
    path = F.concat(F.lit("memory/"), "kind", F.lit("/"), "memory_id")
    active = active.select("bundle_id", path.alias("concept_id"), "memory_id", "kind")
    return hits.join(active, ["bundle_id", "concept_id"]).orderBy(F.desc("score"), "bundle_id", "concept_id").limit(min(limit, 20))


def invalidated(changed: DataFrame, resolved: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """What changed files (bundle_id, source_path) make stale, as (bundle_id, what, key, target).

    A concept: its page, its search document, the backlinks of whatever its links point to (also directories and
    broken targets) and its outbound edges. An index: the pages of its directory and of all above. A log: the
    history of its own directory, and the aggregate one. ``concepts``, where given, says which files are concepts.
    """
    kind = F.when(F.col("source_path").rlike(r"(^|/)index\.md$"), "index").when(F.col("source_path").rlike(r"(^|/)log\.md$"), "log").otherwise("concept")
    rows = changed.withColumn("kind", kind)
    own = rows.where("kind = 'concept'").select("bundle_id", F.regexp_replace("source_path", r"\.md$", "").alias("concept_id"))
    if concepts is not None:
        own = own.join(concepts.select("bundle_id", "concept_id").distinct(), ["bundle_id", "concept_id"], "left_semi")
    none, scope = F.lit(None).cast("string").alias("target"), parent(F.col("source_path"))
    pages = own.select("bundle_id", F.explode(F.array(F.lit("page"), F.lit("search"))).alias("what"), F.col("concept_id").alias("key"), none)
    links = resolved.where("target_id is not null").select("bundle_id", "source_id", F.col("target_id")).join(own.select("bundle_id", F.col("concept_id").alias("source_id")), ["bundle_id", "source_id"], "left_semi")
    back = links.select("bundle_id", F.lit("backlinks").alias("what"), F.col("target_id").alias("key"), none)
    out = links.select("bundle_id", F.lit("edge").alias("what"), F.col("source_id").alias("key"), F.col("target_id").alias("target"))
    above = rows.where("kind = 'index'").select("bundle_id", F.lit("directory").alias("what"), F.explode(ancestors(scope)).alias("key"), none)
    logs = rows.where("kind = 'log'")
    history = logs.select("bundle_id", F.lit("history").alias("what"), scope.alias("key"), none).unionByName(logs.select("bundle_id", F.lit("aggregate history").alias("what"), F.lit("").alias("key"), none))
    return pages.unionByName(back).unionByName(out).unionByName(above).unionByName(history).distinct()


def owning_bundle(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the bundle of its longest root. The path's own prefixes meet the roots by equality."""
    prefixes = paths.select("path", F.explode(ancestors(parent(F.col("path")))).alias("root"))
    found = prefixes.join(roots, "root").groupBy("path").agg(F.max_by("bundle_id", F.length("root")).alias("bundle_id"))
    return paths.join(found, "path", "left")


def routes(concepts: DataFrame) -> DataFrame:
    """The pages of a site: one per concept and directory, and the fixed ones of a bundle."""
    fixed = concepts.select("bundle_id").distinct().select("bundle_id", F.explode(F.array(*[F.lit(x) for x in ("bundle", "facets", "search", "graph", "changes", "diagnostics")])).alias("kind"))
    segment = lambda path: F.array_join(F.transform(F.split(path, "/"), percent_encode), "/")
    b = percent_encode(F.col("bundle_id"))
    a = fixed.select("kind", F.when(F.col("kind") == "bundle", F.concat(F.lit("/"), b, F.lit("/"))).otherwise(F.concat(F.lit("/"), b, F.lit("/"), "kind", F.lit("/"))).alias("route"))
    c = concepts.select(F.lit("concept").alias("kind"), F.concat(F.lit("/"), b, F.lit("/concept/"), segment(F.col("concept_id")), F.lit("/")).alias("route"))
    d = directories(concepts).where("path <> ''").select(F.lit("directory").alias("kind"), F.concat(F.lit("/"), b, F.lit("/directory/"), segment(F.col("path")), F.lit("/")).alias("route"))
    return a.unionByName(c).unionByName(d).distinct()


def directory_body(tree: DataFrame, concepts: DataFrame) -> DataFrame:
    """A listing for directories without an index: title, directories, then concepts with a differing title."""
    names = concepts.select("bundle_id", "concept_id", "title")
    rows = tree.select("bundle_id", "path", "child_directories", F.explode_outer("concepts").alias("concept_id")).join(names, ["bundle_id", "concept_id"], "left")
    base = F.substring_index("concept_id", "/", -1)
    line = F.concat(F.lit("- "), base, F.when(F.col("title").isNotNull() & (F.col("title") != base), F.concat(F.lit(" — "), "title")).otherwise(""))
    grouped = rows.groupBy("bundle_id", "path", "child_directories").agg(F.array_sort(F.collect_list(F.when(F.col("concept_id").isNotNull(), line))).alias("lines"))
    title = F.initcap(F.translate(F.when(F.col("path") == "", F.col("bundle_id")).otherwise(F.substring_index("path", "/", -1)), "-_", "  "))
    children = F.transform("child_directories", lambda p: F.concat(F.lit("- "), F.substring_index(p, "/", -1)))
    part = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {name}\n\n"), F.array_join(items, "\n"))).otherwise("")
    return grouped.select("bundle_id", "path", F.concat(F.lit("# "), title, part("Directories", children), part("Concepts", F.col("lines"))).alias("body"))


