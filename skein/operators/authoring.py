"""Pages of knowledge bundles written one at a time: checked paths, frontmatter, optimistic replacement."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from skein.operators.storage import Files
from skein.sources.bundle import split_frontmatter

KNOWN = ("type", "title", "description", "resource", "tags", "timestamp")
RESERVED = ("index.md", "log.md")


class AuthoringError(ValueError):
    """A refused write: a code and what was wrong."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def relative_parts(path: str, here: bool = True) -> list[str]:
    """The components of a relative path without ``..``; ``here`` allows a leading ``./``."""
    if not path.strip():
        raise AuthoringError("invalid_request", "path must not be blank")
    parts = path.split("/")
    if path.startswith("/") or ".." in parts or (parts[0] == "." and not here):
        raise AuthoringError("path_outside_repository", path)
    parts = [p for p in parts if p not in ("", ".")]
    if not parts:
        raise AuthoringError("invalid_request", "path must not be blank")
    return parts


def page_path(path: str) -> str:
    """A page's path with its ``.md``; other suffixes and the reserved names are refused."""
    *folders, name = relative_parts(path)
    stem, dot, suffix = name.rpartition(".")
    if not stem:  # no dot, or one that opens the name
        name += ".md"
    elif suffix.lower() != "md":
        raise AuthoringError("invalid_request", "page paths must end with `.md` or omit the extension")
    if name.lower() in RESERVED:
        raise AuthoringError("invalid_request", f"`{'/'.join([*folders, name])}` is a reserved source path")
    return "/".join([*folders, name])


def parse_document(content: str) -> tuple[dict, str]:
    """(frontmatter, body); frontmatter that is not closed or not a mapping is refused."""
    import yaml

    front, body, _ = split_frontmatter(content)
    if front is None:
        return {}, content
    lines = content.split("\n")
    if not any(line.rstrip("\r") == "---" for line in lines[1:]):
        raise AuthoringError("invalid_frontmatter", "frontmatter is missing a closing delimiter")
    try:
        fields = yaml.safe_load(front) or {}
    except yaml.YAMLError as e:
        raise AuthoringError("invalid_frontmatter", f"frontmatter is invalid: {e}") from e
    if not isinstance(fields, dict) or not all(isinstance(k, str) for k in fields):
        raise AuthoringError("invalid_frontmatter", "frontmatter is invalid: not a mapping of names")
    return fields, body


def render_document(frontmatter: dict, body: str) -> str:
    """Keys in order of their names; no frontmatter leaves the body alone."""
    import yaml

    if not frontmatter:
        return body
    return f"---\n{yaml.safe_dump(frontmatter, sort_keys=True, allow_unicode=True, default_flow_style=False, width=1 << 30)}---\n{body}"


def content_hash(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


@dataclass
class Page:
    """What a page's frontmatter shall hold; blank fields are left out."""

    type: str
    title: str | None = None
    description: str | None = None
    resource: str | None = None
    tags: list[str] = field(default_factory=list)
    timestamp: str | None = None
    extensions: dict = field(default_factory=dict)

    def frontmatter(self, existing: dict | None = None) -> dict:
        """Own fields over own extensions over ``existing`` extensions."""
        if not self.type.strip():
            raise AuthoringError("invalid_frontmatter", "frontmatter `type` must not be blank")
        kept = {k: v for k, v in (existing or {}).items() if k not in KNOWN}
        own = {k: getattr(self, k) for k in KNOWN if k != "tags"}
        return kept | self.extensions | {k: v for k, v in own.items() if v and v.strip()} | ({"tags": list(self.tags)} if self.tags else {})


def check_page(frontmatter: dict, path: str) -> None:
    kind = frontmatter.get("type")
    if not isinstance(kind, str) or not kind.strip():
        raise AuthoringError("invalid_frontmatter", f"{path} requires a non-empty `type` field")
    if "okf_version" in frontmatter:
        raise AuthoringError("invalid_frontmatter", f"{path} must not declare okf_version")


def default_body(title: str | None, path: str) -> str:
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    words = [w[0].upper() + w[1:] for w in stem.replace("_", "-").split("-") if w]
    return f"# {title if title and title.strip() else ' '.join(words)}\n"


def create_bundle(spark: SparkSession, root: str, bundle_id: str, version: str, title: str | None = None, body: str = "") -> dict:
    """A folder with an ``index.md``; one that exists is refused."""
    if not bundle_id.strip():
        raise AuthoringError("invalid_request", "bundle_id must not be blank")
    if not version.strip():
        raise AuthoringError("invalid_request", "okf_version must not be blank")
    files = Files(spark, root)
    content = render_document({"okf_version": version} | ({"title": title} if title and title.strip() else {}), body)
    if files.exists("") or not files.create("index.md", content):
        raise AuthoringError("bundle_exists", bundle_id)
    return {"bundle_id": bundle_id, "index_path": "index.md", "content_hash": content_hash(content)}


def create_page(spark: SparkSession, root: str, path: str, page: Page, body: str | None = None) -> dict:
    """A new page. The file system's exclusive create decides between two writers."""
    path = page_path(path)
    front = page.frontmatter()
    check_page(front, path)
    content = render_document(front, default_body(page.title, path) if body is None else body)
    if not Files(spark, root).create(path, content):
        raise AuthoringError("concept_exists", path)
    return {"source_path": path, "content_hash": content_hash(content)}


def populate_page(spark: SparkSession, root: str, path: str, page: Page, body: str, expected_hash: str | None = None) -> dict:
    """Replace a page, keeping extensions it has. With ``expected_hash`` a page changed meanwhile is a conflict."""
    path, files = page_path(path), Files(spark, root)
    if not files.exists(path):
        raise AuthoringError("concept_not_found", path)
    before = files.read(path)
    if expected_hash is not None and expected_hash != content_hash(before):
        raise AuthoringError("write_conflict", path)
    front = page.frontmatter(parse_document(before)[0])
    check_page(front, path)
    content = render_document(front, body)
    files.replace(path, content)
    return {"source_path": path, "content_hash": content_hash(content)}
