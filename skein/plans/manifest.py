"""Scan, manifest and artifact queries; documents stand for files, an older state is derived by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import matches_glob
from skein.operators import manifest as M
from skein.plans.registry import query, table
from skein.sources import scan

SUFFIXES = (".py", ".md", ".RS", ".txt", ".go", ".hpp", ".f90", "")
FOLDERS = ("src", "target", "src/build", "docs", "docs2", "node_modules/x")
FILES_SQL = "f AS (SELECT list_value(" + ", ".join(f"'{x}'" for x in FOLDERS) + ")[doc_id % 6 + 1] || '/f' || doc_id || list_value(" + ", ".join(f"'{x}'" for x in SUFFIXES) + ")[doc_id % 8 + 1] AS path, sha256(text) AS content_hash, n_chars AS byte_len, doc_id FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat(pick(FOLDERS, 6), F.lit("/f"), "doc_id", pick(SUFFIXES, 8))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("byte_len"), "doc_id")


LANGUAGE_SQL = "CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scan.LANGUAGES.items()) + " END"


@query("language_by_suffix", f"WITH {FILES_SQL} SELECT path, {LANGUAGE_SQL} AS language FROM f")
def language_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", scan.language(F.col("path")).alias("language"))


#: Components to try: all that are excluded, and near ones that aren't.
TRIED = (*scan.EXCLUDED, scan.STATE, "build", "__pycache__", ".idea", "targets", "coverage", ".github")
NEVER = ".bzr .cache .direnv .eggs .git .hg .mypy_cache .nox .svn .tox .venv dist node_modules target venv .skein".split()


@query("path_exclusion", "WITH f AS (SELECT doc_id, list_value(" + ", ".join(f"'{x}'" for x in TRIED) + f")[doc_id % {len(TRIED)} + 1] AS c FROM documents), p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a/' || c || '/f' || doc_id ELSE c || '/f' || doc_id END AS path, c FROM f) SELECT path FROM p WHERE c NOT IN (" + ", ".join(f"'{x}'" for x in NEVER) + ")")
def path_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    component = F.element_at(F.array(*[F.lit(c) for c in TRIED]), (n % len(TRIED) + 1).cast("int"))
    path = F.concat(F.when(n % 2 == 0, "a/").otherwise(""), component, F.lit("/f"), n)
    return table(spark, sf_dir, "documents").select(path.alias("path")).where(~scan.is_excluded(F.col("path")))


@query("source_scan", f"WITH {FILES_SQL}, l AS (SELECT *, {LANGUAGE_SQL} AS language FROM f WHERE NOT list_has_any(string_split(path, '/'), ['target', 'node_modules'])) SELECT path, byte_len, language, CASE WHEN starts_with(path, 'docs') OR regexp_full_match(path, 'src/f1.*') OR regexp_full_match(split_part(path, '/', -1), '.*7\\.go') THEN 'ignored' WHEN language IS NULL THEN 'unsupported' ELSE 'source' END AS status FROM l")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classified(files(spark, sf_dir), ignore=["docs/", "# a comment", ""], exclude=["src/f1*", "*7.go"]).select("path", "byte_len", "language", "status")


@query("glob_filter", "SELECT page_id, url, regexp_full_match(url, '.*/p.*') AS deep, regexp_full_match(split_part(url, '/', -1), '.*[0-2].') OR regexp_full_match(url, '.*[0-2].') AS tail, starts_with(url, 'http') AS below, regexp_full_match(url, 'h.*/p.*') AS dotted FROM pages")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", matches_glob(url, "*/p*").alias("deep"), (matches_glob(url, "*0?") | matches_glob(url, "*1?") | matches_glob(url, "*2?")).alias("tail"), matches_glob(url, "http/").alias("below"), matches_glob(url, " ./h*\\p* ").alias("dotted"))


BEFORE_SQL = "b AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash, doc_id FROM f WHERE doc_id % 10 <> 0 UNION ALL SELECT 'gone/' || doc_id, 'x', doc_id FROM f WHERE doc_id % 9 = 0)"


def before(f: DataFrame) -> DataFrame:
    kept = f.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), "doc_id")
    gone = f.where("doc_id % 9 = 0").select(F.concat(F.lit("gone/"), "doc_id").alias("path"), F.lit("x").alias("content_hash"), "doc_id")
    return kept.unionByName(gone).withColumn("language", scan.language(F.col("path")))


DIFF_SQL = f"{FILES_SQL}, {BEFORE_SQL}, d AS (SELECT coalesce(f.path, b.path) AS path, CASE WHEN f.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'added' WHEN f.content_hash = b.content_hash THEN 'unchanged' ELSE 'modified' END AS status FROM f FULL JOIN b ON f.path = b.path)"


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("language", scan.language(F.col("path")))
    return M.diff(f, before(f))


@query("manifest_diff", f"WITH {DIFF_SQL} SELECT * FROM d")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir)


@query("plan_summary", f"WITH {DIFF_SQL}, s AS (SELECT path, CASE WHEN starts_with(path, 'docs') THEN 'ignored' WHEN {LANGUAGE_SQL} IS NULL THEN 'unsupported' ELSE 'source' END AS status FROM f WHERE NOT list_has_any(string_split(path, '/'), ['target', 'node_modules'])) SELECT (SELECT count(*) FROM s) AS scanned, (SELECT count(*) FROM s WHERE status = 'ignored') AS ignored, (SELECT count(*) FROM s WHERE status = 'unsupported') AS unsupported, count(*) FILTER (status IN ('added', 'modified')) AS rebuilt, count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'deleted') AS deleted FROM d")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(scan.classified(files(spark, sf_dir), ignore=["docs/"]), plan(spark, sf_dir))


@query("plan_candidates", f"WITH {DIFF_SQL} SELECT * FROM d WHERE status = 'deleted' OR path IN (SELECT path FROM f WHERE doc_id % 4 = 1)")
def plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.candidates(plan(spark, sf_dir), files(spark, sf_dir).where("doc_id % 4 = 1"))


@query("artifact_reuse_anti", f"WITH {FILES_SQL} SELECT path FROM f WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)")
def artifact_reuse_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("artifact_key", M.artifact_key({"parser": "1"}, "path", "content_hash"))
    cached = f.where("doc_id % 3 = 0").select("artifact_key", F.col("path").alias("payload"), F.when(F.col("doc_id") % 5 == 0, "damaged").otherwise(F.sha2("path", 256)).alias("payload_hash"))
    return M.to_build(f, cached).select("path")


@query("artifact_garbage", f"WITH {FILES_SQL} SELECT sha256(path) AS artifact_key FROM f WHERE doc_id % 4 = 0")
def artifact_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", F.sha2("path", 256).alias("artifact_key"))
    return M.garbage(f, f.where("doc_id % 4 <> 0"))


@query("poll_snapshot_diff", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS m, o_custkey AS l FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS m, o_custkey AS l FROM orders WHERE o_orderkey % 13 <> 0) SELECT 'f' || coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'deleted' WHEN b.k IS NULL THEN 'created' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.m IS DISTINCT FROM b.m OR a.l IS DISTINCT FROM b.l")
def poll_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"), F.col("o_custkey").alias("byte_len"))
    return M.snapshot_changes(o.where("o_orderkey % 11 <> 0"), o.where("o_orderkey % 13 <> 0").withColumn("mtime", F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("mtime"))))


@query("progress_latest", "SELECT event_type AS phase, max(event_id) AS at, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_by_phase(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("event_id").alias("at"), "value"))
