"""Source scans: files with content hash, language and exclusion, as a DataFrame."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import matches_any

#: Path components that are never scanned (fixed values), beside the folder of the engine's own state.
EXCLUDED = (".bzr", ".cache", ".direnv", ".eggs", ".git", ".hg", ".mypy_cache", ".nox", ".svn", ".tox", ".venv", "dist", "node_modules", "target", "venv")
STATE = ".skein"
#: Languages by suffix (fixed values); later profiles override.
LANGUAGES = {".py": "python", ".md": "markdown", ".mdx": "markdown", ".rs": "rust", ".go": "go", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".f": "fortran", ".f90": "fortran", ".f95": "fortran", ".for": "fortran"}


def language(path: Column, languages: dict[str, str] | None = None) -> Column:
    """By the suffix, letter case aside; null if none fits."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = None
    for own, name in {**LANGUAGES, **(languages or {})}.items():
        out = F.when(suffix == own, name) if out is None else out.when(suffix == own, name)
    return out


def is_excluded(path: Column, components: tuple[str, ...] = EXCLUDED, state: str = STATE) -> Column:
    """Whether any component of the path is one of ``components`` or the state folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(c) for c in (*components, state)]))


def is_ignored(path: Column, include: list[str] = (), ignore: list[str] = (), exclude: list[str] = ()) -> Column:
    """An include list must match if there is one; then ignore and exclude patterns drop."""
    kept = matches_any(path, list(include)) if include else F.lit(True)
    return ~kept | matches_any(path, [*ignore, *exclude])


def classified(files: DataFrame, include: list[str] = (), ignore: list[str] = (), exclude: list[str] = (), languages: dict[str, str] | None = None) -> DataFrame:
    """Files (path, ...) without excluded ones, with language and status: ignored, unsupported or source."""
    path = F.col("path")
    out = files.where(~is_excluded(path)).withColumn("language", language(path, languages))
    status = F.when(is_ignored(path, include, ignore, exclude), "ignored").when(F.col("language").isNull(), "unsupported").otherwise("source")
    return out.withColumn("status", status)


def diagnostics(scanned: DataFrame) -> DataFrame:
    """A message for each file that isn't source."""
    text = F.when(F.col("status") == "ignored", F.concat(F.lit("Ignored file "), "path")).otherwise(F.concat(F.lit("Skipped unsupported file "), "path"))
    return scanned.where("status <> 'source'").select("path", text.alias("message"))


def scan(spark: SparkSession, root: str, include: list[str] = (), ignore: list[str] = (), exclude: list[str] = (), languages: dict[str, str] | None = None) -> DataFrame:
    """(path, absolute_path, content_hash, language, byte_len, status, content) of the files under ``root``.

    Contents are read and hashed only for the rows and columns that a plan keeps.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = str(Path(root).resolve()) if "://" not in root else root.rstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//)?", ""), "^" + _quoted(base.split(":", 1)[-1].lstrip("/") if "://" in base else base.lstrip("/"), "/?") + "/", "")
    relative = files.select(inside.alias("path"), F.col("path").alias("absolute_path"), F.col("length").alias("byte_len"), "content")
    out = classified(relative, include, ignore, exclude, languages)
    digest = F.when(F.col("status") == "source", F.sha2("content", 256)).otherwise("")
    return out.select("path", "absolute_path", digest.alias("content_hash"), "language", "byte_len", "status", F.when(F.col("status") == "source", F.col("content")).alias("content"))


def _quoted(text: str, before: str) -> str:
    import re

    return before + re.escape(text)


def read_rules(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file, without blank and comment lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    return [r["v"] for r in lines.collect()]


def git_paths(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Tracked and untracked files, or those changed since a revision: distinct, sorted paths."""
    commands = [["ls-files", "--cached", "--others", "--exclude-standard"]] if since is None else [["diff", "--name-only", "--diff-filter=ACMRTD", since], ["ls-files", "--others", "--exclude-standard"]]
    found = set()
    for command in commands:
        found |= set(subprocess.run(["git", "-C", root, *command], capture_output=True, text=True, check=True).stdout.splitlines())
    return spark.createDataFrame([(p,) for p in sorted(found)], "path string")
