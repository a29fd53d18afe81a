"""Knowledge bundles: Markdown files with YAML frontmatter, as typed rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "bundle_id string, source_path string, kind string, has_frontmatter boolean, parsed boolean, type string, title string, description string, resource string, "
    "tags array<string>, timestamp string, okf_version string, extensions string, key_lines map<string,int>, body_markdown string, body_start_line int, "
    "diagnostics array<struct<severity:string,code:string,line:int,message:string>>"
)
PLAIN_TAGS = {f"tag:yaml.org,2002:{k}" for k in ("str", "int", "float", "bool", "null", "timestamp", "seq", "map", "merge")}
STANDARD = ("type", "title", "description", "resource", "timestamp", "okf_version")


def entry_kind(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name == "index.md", "index").when(name == "log.md", "log").otherwise("concept")


def concept_id(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def split_frontmatter(text: str) -> tuple[str | None, str, int]:
    """(frontmatter, body, the body's first line)."""
    rows = text.split("\n")
    if len(rows) < 2 or rows[0].rstrip("\r") != "---":
        return None, text, 1
    for i, row in enumerate(rows[1:], 1):
        if row.rstrip("\r") == "---":
            return "\n".join(rows[1:i]) + ("\n" if i > 1 else ""), "\n".join(rows[i + 1 :]), i + 2
    return "\n".join(rows[1:]), "", len(rows) + (0 if text.endswith("\n") else 1)


def _yaml(source: str):  # noqa: ANN202
    """The mapping, its keys' lines, and a (line, message) if it isn't valid. Tags are refused."""
    import yaml

    try:
        node = yaml.compose(source, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        return None, {}, (2 + (mark.line if mark else 0), str(getattr(e, "problem", e)))
    if node is None:
        return {}, {}, None
    if not isinstance(node, yaml.MappingNode):
        return None, {}, (2, "frontmatter must be a mapping")
    where = {k.value: k.start_mark.line + 2 for k, _ in node.value if isinstance(k, yaml.ScalarNode)}

    def plain(n):  # noqa: ANN001, ANN202
        if n.tag not in PLAIN_TAGS:
            raise ValueError(f"tag {n.tag} is not allowed")
        if isinstance(n, yaml.ScalarNode):
            kind = n.tag.rsplit(":", 1)[1]
            return n.value if kind in ("str", "timestamp") else yaml.safe_load(n.value) if kind in ("int", "float", "bool", "null") else n.value
        if isinstance(n, yaml.SequenceNode):
            return [plain(x) for x in n.value]
        return {x.value: plain(y) for x, y in n.value}

    out, bad = {}, None
    for k, v in node.value:
        if not isinstance(k, yaml.ScalarNode) or k.tag != "tag:yaml.org,2002:str":
            bad = bad or (1, "frontmatter keys must be strings")
            continue
        try:
            out[k.value] = plain(v)
        except ValueError as e:
            bad = bad or (where[k.value], str(e))
    return out, where, bad


def parse_entry(path: str, text: str) -> dict:
    """One file's typed fields, the rest as JSON extensions, and its diagnostics."""
    front, body, start = split_frontmatter(text)
    out = dict.fromkeys(STANDARD) | {"tags": [], "extensions": "{}", "key_lines": {}, "body_markdown": body, "body_start_line": start, "has_frontmatter": front is not None, "parsed": False, "diagnostics": []}
    if front is None:
        return out
    error = lambda line, message: out["diagnostics"].append(("error", "invalid_frontmatter", line, message))
    fields, where, bad = _yaml(front)
    if bad:
        error(*bad)
    if fields is None:
        return out
    out["parsed"], out["key_lines"] = True, where
    for key in STANDARD:
        if key in fields:
            value = fields[key]
            if not isinstance(value, str):
                error(where.get(key), f"field '{key}' must be a string")
            elif value.strip():
                out[key] = value.strip()
            elif key == "type":
                error(where.get(key), "field 'type' must not be empty")
    tags = fields.get("tags", [])
    if isinstance(tags, str):
        out["tags"] = [tags.strip()]
    elif not isinstance(tags, list):
        error(where.get("tags"), "field 'tags' must be a string or sequence of strings")
    else:
        out["tags"] = [t.strip() for t in tags if isinstance(t, str) and t.strip()]
        for _ in range(len(tags) - len(out["tags"])):
            error(where.get("tags"), "field 'tags' must contain only non-empty strings")
    rest = {k: v for k, v in fields.items() if k not in STANDARD and k != "tags"}
    out["extensions"] = json.dumps(rest, sort_keys=True, default=str)
    return out


CONTENT = "content binary"


def parse(files: DataFrame, hashed: bool = False) -> DataFrame:
    """From (bundle_id, source_path, content binary) to entries; Python reads YAML, in Arrow batches.

    ``hashed`` adds file_hash, of the very bytes that were read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                content = bytes(r.content)
                try:
                    text, bad = content.decode(), []
                except UnicodeDecodeError:
                    text, bad = "", [("error", "invalid_utf8", 1, "the file is not UTF-8")]
                row = parse_entry(r.source_path, text)
                row["diagnostics"] = bad + row["diagnostics"]
                own = {"bundle_id": r.bundle_id, "source_path": r.source_path, "kind": r.kind, **row}
                rows.append(own | {"file_hash": hashlib.sha256(content).hexdigest()} if hashed else own)
            yield pd.DataFrame(rows, columns=names)

    schema = f"{ENTRY}, file_hash string" if hashed else ENTRY
    names = [c.split()[0] for c in schema.replace("array<struct<severity:string,code:string,line:int,message:string>>", "x").replace("map<string,int>", "x").split(", ")]
    return files.select("bundle_id", "source_path", entry_kind(F.col("source_path")).alias("kind"), "content").mapInPandas(run, schema)


def files(spark: SparkSession, root: str, bundle_id: str | None = None) -> DataFrame:
    """(bundle_id, source_path, absolute_path, content) of the ``.md`` files below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    inside = F.substring_index("path", base + "/", -1)
    whole = [F.col("path").alias("absolute_path"), "content"]
    if bundle_id is None:
        return found.select(F.substring_index(inside, "/", 1).alias("bundle_id"), F.regexp_replace(inside, "^[^/]*/", "").alias("source_path"), *whole)
    return found.select(F.lit(bundle_id).alias("bundle_id"), inside.alias("source_path"), *whole)


def read(spark: SparkSession, root: str, bundle_id: str | None = None) -> DataFrame:
    """The entries of the ``.md`` files below ``root``; the bundle is named by ``bundle_id`` or by each file's first folder."""
    return parse(files(spark, root, bundle_id))
