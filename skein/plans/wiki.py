"""Knowledge queries: pages' links, and bundles derived from documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import ancestors, escape_html, link_kind
from skein.operators import projection
from skein.operators import wiki as W
from skein.operators.storage import materialize
from skein.plans.registry import query, table
from skein.sources import bundle, markdown

HREF = r'href="([^"]*)"'


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


LINKS = f"l AS (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages)"
KIND = "CASE WHEN trim(href) = '' THEN 'rejected' WHEN starts_with(trim(href), '//') THEN 'external' WHEN regexp_matches(trim(href), '^[A-Za-z0-9+.\\-]*:') THEN CASE WHEN lower(regexp_extract(trim(href), '^([A-Za-z0-9+.\\-]*):', 1)) IN ('http', 'https', 'mailto', 'tel') THEN 'external' ELSE 'rejected' END ELSE 'internal' END"


@query("link_extract", f"WITH {LINKS} SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("link_scheme_status", f"WITH {LINKS} SELECT href, {KIND} AS kind, count(*) AS n FROM l GROUP BY ALL")
def link_scheme_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).groupBy("href", link_kind(F.col("href")).alias("kind")).agg(F.count("*").alias("n"))


@query("path_ancestors", "WITH p AS (SELECT doc_id, lang || '/' || source || '/' || (doc_id % 3) AS path FROM documents) SELECT doc_id, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS directory FROM p")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "lang", "source", (F.col("doc_id") % 3).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(ancestors(path)).alias("directory"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("bundle_id"), F.concat("source", F.lit("/c"), "doc_id").alias("concept_id"), F.col("source").alias("type"), F.array("lang", F.concat(F.lit("m"), F.col("doc_id") % 4)).alias("tags"), F.concat(F.lit("Title "), "doc_id").alias("title"), "doc_id")


CONCEPTS = "c AS (SELECT lang AS bundle_id, source || '/c' || doc_id AS concept_id, source AS type, ['' || lang, 'm' || (doc_id % 4)] AS tags, 'Title ' || doc_id AS title, doc_id FROM documents)"


@query("facet_counts", f"WITH {CONCEPTS} SELECT bundle_id, 'type' AS facet, type AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT bundle_id, 'tag', value, count(*) FROM (SELECT bundle_id, unnest(list_distinct(tags)) AS value FROM c) GROUP BY ALL")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.facets(concepts(spark, sf_dir))


@query("directory_hierarchy", f"WITH {CONCEPTS}, d AS (SELECT bundle_id, '' AS path FROM c UNION SELECT bundle_id, type FROM c) SELECT bundle_id, path, CASE WHEN path = '' THEN (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM c WHERE c.bundle_id = d.bundle_id) ELSE '' END AS child_directories, coalesce((SELECT string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) FROM c WHERE c.bundle_id = d.bundle_id AND c.type = d.path), '') AS concepts FROM d")
def directory_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.hierarchy(concepts(spark, sf_dir))
    return t.select("bundle_id", "path", F.array_join("child_directories", ",").alias("child_directories"), F.array_join("concepts", ",").alias("concepts"))


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every form, from each document to the one after it and to others."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    up = F.concat(F.lit("../"), F.col("source"), F.lit("/c"), n + 0)
    form = F.element_at(F.array(F.concat(F.lit("c"), n, F.lit(".md")), F.concat(up, F.lit(".md")), F.lit("https://x.example/a"), F.lit("javascript:go"), F.lit("../../out.md"), F.concat(F.lit("/"), F.col("source"), F.lit("/")), F.lit("missing.md"), F.concat(F.lit("#h-"), n % 2), F.lit("../index.md"), F.lit("//cdn.example/x"), F.lit("../nowhere/"), F.concat(F.lit("c"), n, F.lit("#h-1"))), (n % 12 + 1).cast("int"))
    return d.select(F.col("lang").alias("bundle_id"), F.concat("source", F.lit("/c"), n).alias("source_id"), form.alias("href"), "doc_id")


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("bundle_id"), F.concat("source", F.lit("/c"), "doc_id").alias("concept_id"), F.lit("h-1").alias("slug"))


RESOLVED = """r AS (SELECT lang AS bundle_id, source || '/c' || doc_id AS source_id, CASE doc_id % 12
 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN 'external' WHEN 3 THEN 'rejected' WHEN 4 THEN 'rejected' WHEN 5 THEN 'resolved' WHEN 6 THEN 'broken' WHEN 7 THEN CASE WHEN doc_id % 2 = 1 THEN 'resolved' ELSE 'broken' END
 WHEN 8 THEN 'resolved' WHEN 9 THEN 'external' WHEN 10 THEN 'broken' ELSE 'resolved' END AS status, CASE doc_id % 12
 WHEN 5 THEN 'bundle:' || lang || ':directory:' || source WHEN 6 THEN 'bundle:' || lang || ':concept:' || source || '/missing' WHEN 8 THEN 'bundle:' || lang || ':directory:' WHEN 10 THEN 'bundle:' || lang || ':directory:nowhere'
 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 9 THEN NULL ELSE 'bundle:' || lang || ':concept:' || source || '/c' || doc_id END AS target_id FROM documents)"""


@query("link_resolution", f"WITH {RESOLVED} SELECT * FROM r")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.resolve_links(doc_links(spark, sf_dir), concepts(spark, sf_dir), slugs(spark, sf_dir)).select("bundle_id", "source_id", "status", "target_id")


@query("link_diagnostics", f"WITH {RESOLVED} SELECT bundle_id, status || '_link' AS code, count(*) AS n FROM r WHERE status IN ('broken', 'rejected') GROUP BY ALL")
def link_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = W.resolve_links(doc_links(spark, sf_dir), concepts(spark, sf_dir), slugs(spark, sf_dir))
    return W.link_diagnostics(resolved).groupBy("bundle_id", "code").agg(F.count("*").alias("n"))


@query("backlinks", f"WITH {LINKS} SELECT href AS concept_id, string_agg(DISTINCT page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR) AS backlinks FROM l WHERE {KIND} = 'internal' GROUP BY href")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_links(spark, sf_dir).select(F.lit("web").alias("bundle_id"), F.col("page_id").cast("string").alias("source_id"), F.col("href").alias("target_concept"), link_kind(F.col("href")).alias("kind"))
    good = links.where("kind = 'internal'").withColumn("status", F.lit("resolved"))
    return W.backlinks(good).select("concept_id", F.array_join("backlinks", ",").alias("backlinks"))


@query("log_rollup", "WITH e AS (SELECT lang || '/' || source AS scope, lang, doc_id FROM documents) SELECT directory, count(*) AS n, max(doc_id) AS latest FROM (SELECT unnest(['', lang, scope]) AS directory, doc_id FROM e) GROUP BY directory")
def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("scope"), "doc_id")
    return W.roll_up(entries).groupBy("directory").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))


@query("bundle_summary", f"WITH {CONCEPTS}, {RESOLVED} SELECT bundle_id, a.concepts, a.types, b.links, b.broken FROM (SELECT bundle_id, count(*) AS concepts, count(DISTINCT type) AS types FROM c GROUP BY 1) a JOIN (SELECT bundle_id, count(*) AS links, count(*) FILTER (status = 'broken') AS broken FROM r GROUP BY 1) b USING (bundle_id)")
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.bundle_summary(concepts(spark, sf_dir), W.resolve_links(doc_links(spark, sf_dir), concepts(spark, sf_dir), slugs(spark, sf_dir)))


@query("recent_changes", "SELECT * FROM (SELECT 'u' || user_id % 3 AS bundle_id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 2 = 0 THEN 'concept' ELSE 'log' END AS kind, 'e' || event_id AS what FROM events) ORDER BY date DESC, bundle_id, kind, what LIMIT 200")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 3).alias("bundle_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("e"), "event_id").alias("what"), "event_id")
    a = e.where("event_id % 2 = 0").select("bundle_id", F.col("date").alias("timestamp"), F.col("what").alias("concept_id"))
    return W.recent_changes(a, e.where("event_id % 2 <> 0").select("bundle_id", "date", F.col("what").alias("entry")), 200)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading for each turn, its text, and a preface that belongs to no section."""
    t = table(spark, sf_dir, "conversations")
    one = F.concat(F.lit("# "), "role", F.lit(" "), "turn", F.lit("\n"), F.regexp_replace("text", r"[#\r\n]+", " "), F.lit("\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", one.alias("t"))))
    return t.groupBy("conv_id").agg(F.concat(F.lit("preface\n"), F.array_join(F.transform(turns, lambda x: x["t"]), "\n")).alias("text"))


@query("markdown_sections", r"SELECT conv_id, role || ' ' || turn AS heading, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 3 - 1 AS INTEGER) AS line_start, trim('# ' || role || ' ' || turn || chr(10) || trim(regexp_replace(text, '[#\r\n]+', ' ', 'g'), ' ')) AS body FROM conversations")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.sections(notes(spark, sf_dir), ["conv_id"])
    return found.select("conv_id", "heading", "line_start", F.regexp_replace("body", r"\n ", "\n").alias("body"))


@query("heading_slugs", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, 1 AS level, role || ' ' || turn AS heading, role || '-' || turn AS slug FROM conversations")
def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.headings(notes(spark, sf_dir), ["conv_id"])


@query("log_entries", "WITH u AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN lag(1, 1) OVER w ELSE NULL END AS x, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, '2026-01-' || lpad((turn % 28 + 1)::VARCHAR, 2, '0') AS date, role AS category, 'did ' || turn || ' again [a](x' || turn || '.md)' AS entry, 'x' || turn || '.md' AS href FROM conversations")
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    day = F.concat(F.lit("## 2026-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("\n### "), "role", F.lit("\n- did "), "turn", F.lit("\n  again [a](x"), "turn", F.lit(".md)\n"))
    docs = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", day.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return markdown.log_entries(docs, ["conv_id"]).select("conv_id", "date", "category", "entry", F.col("hrefs")[0].alias("href"))


ENTRIES = "e AS (SELECT 'b' || conv_id % 3 AS bundle_id, CASE turn WHEN 0 THEN 'index.md' WHEN 1 THEN 'n/log.md' ELSE role || '/c' || turn || '.md' END AS source_path, turn, length(text) AS n, CASE turn WHEN 0 THEN 'index' WHEN 1 THEN 'log' ELSE 'concept' END AS kind, turn % 3 <> 1 AS front FROM conversations)"


@query("conformance_rules", f"WITH {ENTRIES}, x AS (SELECT bundle_id, source_path, unnest([CASE WHEN kind = 'concept' AND NOT front THEN 'missing_frontmatter' END, CASE WHEN kind = 'concept' AND front AND n % 5 = 0 THEN 'missing_type' END, CASE WHEN kind = 'log' AND front THEN 'reserved_frontmatter' END, CASE WHEN kind = 'concept' AND front THEN 'recommended_title_missing' END, CASE WHEN kind = 'concept' AND front AND n % 2 = 0 THEN 'recommended_description_missing' END, CASE WHEN kind = 'index' THEN 'recommended_okf_version_missing' END]) AS code FROM e) SELECT bundle_id, code, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY ALL UNION ALL SELECT bundle_id, 'recommended_okf_version_missing', 1 FROM e GROUP BY bundle_id HAVING count(*) FILTER (kind = 'index') = 0")
def conformance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = table(spark, sf_dir, "conversations"), F.length("text")
    path = F.when(F.col("turn") == 0, "index.md").when(F.col("turn") == 1, "n/log.md").otherwise(F.concat("role", F.lit("/c"), "turn", F.lit(".md")))
    front = F.col("turn") % 3 != 1
    kind = F.when(F.col("turn") == 0, "index").when(F.col("turn") == 1, "log").otherwise("concept")
    none = F.lit(None).cast("string")
    entries = t.select(F.concat(F.lit("b"), F.col("conv_id") % 3).alias("bundle_id"), path.alias("source_path"), kind.alias("kind"), front.alias("has_frontmatter"), front.alias("parsed"), F.when(n % 5 != 0, "note").alias("type"), none.alias("title"), F.when(n % 2 != 0, "d").alias("description"), none.alias("okf_version"), F.lit("{}").alias("extensions"), F.create_map(F.lit("type"), F.lit(2)).alias("key_lines"), F.array().cast("array<struct<severity:string,code:string,line:int,message:string>>").alias("diagnostics"))
    return W.conformance(entries).groupBy("bundle_id", "code").agg(F.count("*").alias("n"))


STATUS = "['candidate', 'active', 'quarantined', 'superseded']"


@query("memory_state_machine", f"""WITH r AS (SELECT 'b' || doc_id % 2 AS bundle_id, doc_id, 'm' || doc_id AS memory_id, {STATUS}[doc_id % 4 + 1] AS from_status, {STATUS}[doc_id // 4 % 4 + 1] AS to_status, CASE WHEN doc_id % 50 = 7 THEN '' ELSE 'ann' END AS actor, CASE WHEN doc_id // 4 % 4 = 3 AND doc_id % 3 <> 0 THEN 'm' || (doc_id + 4) END AS replacement_id FROM documents), k AS (SELECT 'm' || doc_id AS replacement_id, {STATUS}[doc_id % 4 + 1] AS new_status, doc_id FROM documents)
SELECT *, CASE WHEN error IS NULL AND to_status = 'active' THEN 'ann' END AS verified_by, CASE WHEN error IS NULL AND to_status = 'superseded' THEN 'm' || (CAST(substr(memory_id, 2) AS BIGINT) + 4) END AS superseded_by, CASE WHEN error IS NULL THEN from_status || '>' || to_status || '>ann>t>why' ELSE '' END AS history FROM (
SELECT bundle_id, memory_id, from_status, to_status, CASE WHEN actor = '' THEN 'actor must not be empty' WHEN NOT ((from_status, to_status) IN (('candidate', 'active'), ('candidate', 'quarantined'), ('active', 'superseded'), ('active', 'quarantined'), ('quarantined', 'candidate'))) THEN 'transition from ' || upper(from_status[1]) || from_status[2:] || ' to ' || upper(to_status[1]) || to_status[2:] || ' is not allowed'
 WHEN to_status = 'superseded' AND r.replacement_id IS NULL THEN 'supersession requires replacement_id' WHEN to_status = 'superseded' AND new_status IS NULL THEN 'supersession replacement was not found' WHEN to_status = 'superseded' AND new_status <> 'active' THEN 'supersession replacement must be active' WHEN to_status = 'superseded' AND k.doc_id % 5 = 0 THEN 'replacement must declare the memory it supersedes' END AS error FROM r LEFT JOIN k USING (replacement_id))""")
def memory_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda i: F.element_at(F.array(*[F.lit(s) for s in ("candidate", "active", "quarantined", "superseded")]), (i + 1).cast("int"))
    bundle = F.concat(F.lit("b"), n % 2).alias("bundle_id")
    to = pick(F.floor(n / 4) % 4)
    requests = d.select(bundle, F.concat(F.lit("m"), n).alias("memory_id"), to.alias("to_status"), F.when(n % 50 == 7, "").otherwise("ann").alias("actor"), F.lit("t").alias("at"), F.lit("why").alias("reason"), F.when((to == "superseded") & (n % 3 != 0), F.concat(F.lit("m"), n + 4)).alias("replacement_id"))
    records = d.select(bundle, F.concat(F.lit("m"), n).alias("memory_id"), pick(n % 4).alias("status"), F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("m"), n - 4))).alias("supersedes"))
    steps = F.array_join(F.transform("history", lambda h: F.concat_ws(">", h["from"], h["to"], h["actor"], h["at"], h["reason"])), ",")
    return W.transitions(requests, records).select("bundle_id", "memory_id", "from_status", "to_status", "error", "verified_by", "superseded_by", steps.alias("history"))


@query("memory_recall", f"WITH r AS (SELECT 'b' AS bundle_id, 'memory/' || kind || '/m' || doc_id AS concept_id, 'm' || doc_id AS memory_id, kind, n_chars AS score FROM (SELECT *, ['semantic', 'episodic', 'procedural'][doc_id % 3 + 1] AS kind FROM documents) WHERE doc_id % 4 = 1 AND kind <> 'procedural') SELECT bundle_id, concept_id, memory_id, kind, score FROM r ORDER BY score DESC, bundle_id, concept_id LIMIT 20")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("semantic"), F.lit("episodic"), F.lit("procedural")), (n % 3 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.lit("b").alias("bundle_id"), kind.alias("kind"), F.concat(F.lit("m"), n).alias("memory_id"), F.when(n % 4 == 1, "active").otherwise("candidate").alias("status"), F.col("n_chars").alias("score"))
    hits = d.select("bundle_id", F.concat(F.lit("memory/"), "kind", F.lit("/"), "memory_id").alias("concept_id"), "score")
    return W.recall(hits, d.drop("score"), ["semantic", "episodic"]).select("bundle_id", "concept_id", "memory_id", "kind", "score")


INVALID = f"""WITH {CONCEPTS}, {RESOLVED}, s AS (SELECT DISTINCT r.bundle_id, r.source_id, r.target_id FROM r JOIN c ON c.concept_id = r.source_id AND c.bundle_id = r.bundle_id WHERE c.doc_id % 9 = 0 AND r.target_id IS NOT NULL)
SELECT bundle_id, 'page' AS what, concept_id AS key, NULL::VARCHAR AS target FROM c WHERE doc_id % 9 = 0
UNION SELECT bundle_id, 'search', concept_id, NULL FROM c WHERE doc_id % 9 = 0
UNION SELECT bundle_id, 'backlinks', target_id, NULL FROM s
UNION SELECT bundle_id, 'edge', source_id, target_id FROM s
UNION SELECT bundle_id, 'directory', unnest(['', type, type || '/deep']), NULL FROM c WHERE doc_id % 9 = 1
UNION SELECT bundle_id, 'history', type || '/deep', NULL FROM c WHERE doc_id % 9 = 2
UNION SELECT bundle_id, 'aggregate history', '', NULL FROM c WHERE doc_id % 9 = 2"""


@query("invalidation", INVALID)
def invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concepts(spark, sf_dir)
    n = F.col("doc_id") % 9
    own = F.when(n == 0, F.concat("concept_id", F.lit(".md"))).when(n == 1, F.concat("type", F.lit("/deep/index.md"))).when(n == 2, F.concat("type", F.lit("/deep/log.md"))).otherwise(F.concat(F.lit("no/concept"), F.col("doc_id"), F.lit(".md")))
    changed = c.where("doc_id % 9 < 4").select("bundle_id", own.alias("source_path"))
    return W.invalidated(changed, W.resolve_links(doc_links(spark, sf_dir), c, slugs(spark, sf_dir)), c)


ROOTS = {"": "all", "src1": "one", "src1/en": "english", "src2/de/m1": "deep", "src": "no folder of its own"}


@query("longest_prefix", "WITH p AS (SELECT doc_id, source || '/' || lang || '/m' || doc_id % 3 || '/d' || doc_id || '.md' AS path FROM documents), r(root, bundle_id) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ROOTS.items()) + ") SELECT doc_id, arg_max(bundle_id, length(root)) AS bundle_id FROM p JOIN r ON root = '' OR starts_with(path, root || '/') GROUP BY doc_id")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("m"), F.col("doc_id") % 3), F.concat(F.lit("d"), "doc_id", F.lit(".md")))
    paths = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    found = W.owning_bundle(paths.select("path"), spark.createDataFrame(list(ROOTS.items()), "root string, bundle_id string"))
    return paths.join(found, "path").select("doc_id", "bundle_id")


@query("site_routes", f"WITH {CONCEPTS} SELECT 'concept' AS kind, '/' || bundle_id || '/concept/' || concept_id || '/' AS route FROM c UNION SELECT 'directory', '/' || bundle_id || '/directory/' || type || '/' FROM c UNION SELECT k, '/' || bundle_id || CASE WHEN k = 'bundle' THEN '/' ELSE '/' || k || '/' END FROM c, (SELECT unnest(['bundle', 'facets', 'search', 'graph', 'changes', 'diagnostics']) AS k)")
def site_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.routes(concepts(spark, sf_dir))


@query("html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(escape_html(F.col("html")).cast("binary")).alias("digest"))


def linked_pages(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents as pages of their language's bundle: a link to the next document's page, then the whole text."""
    after = folders.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("../"), "source", F.lit("/c"), "doc_id", F.lit(".md")).alias("href"))
    rows = documents.join(after, "doc_id", "left")
    content = F.concat(F.lit("[next]("), F.coalesce("href", F.lit("../none.md")), F.lit(")\n\n"), F.coalesce("text", F.lit("")))
    return rows.select(F.col("lang").alias("bundle_id"), F.concat("source", F.lit("/c"), "doc_id", F.lit(".md")).alias("source_path"), content.cast("binary").alias("content"))


NEXT_SQL = """WITH n AS (SELECT d.lang AS bundle_id, d.source || '/c' || d.doc_id AS source_id, CASE WHEN e.doc_id IS NULL THEN '../none.md' ELSE '../' || e.source || '/c' || e.doc_id || '.md' END AS href,
 e.doc_id IS NOT NULL AND e.lang = d.lang AND e.doc_id % 10 <> 7 AS there FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1 WHERE d.doc_id % 10 <> 7 AND d.lang IS NOT NULL AND d.source IS NOT NULL)
SELECT bundle_id, source_id, href, CASE WHEN there THEN 'resolved' ELSE 'broken' END AS status FROM n"""


@query("projection_updated", NEXT_SQL)
def projection_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after a tenth of the pages came, a tenth went and a tenth changed, from the tables before and the changed pages."""
    documents = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    folders = documents.select("doc_id", "source")

    def stored(tables: dict) -> dict:
        out: dict = {}
        for name in ("entries", "concepts", "headings", "citations", "links"):
            made = tables[name]
            out[name] = materialize(made(out) if callable(made) else made, name)
        return out

    parsed = lambda rows: materialize(bundle.parse(linked_pages(rows, folders), hashed=True), "parsed")
    draft = F.when(F.col("doc_id") % 10 == 5, F.lit("a draft")).otherwise(F.col("text"))
    before = stored(projection.compiled(parsed(documents.where("doc_id % 10 <> 3").withColumn("text", draft))))
    changed = documents.where("doc_id % 10 in (3, 5, 7)").select(F.col("lang").alias("bundle_id"), F.concat("source", F.lit("/c"), "doc_id", F.lit(".md")).alias("source_path"))
    after = stored(projection.updated(before, parsed(documents.where("doc_id % 10 in (3, 5)")), changed))
    return after["links"].where("context = 'next'").select("bundle_id", "source_id", "href", "status")
