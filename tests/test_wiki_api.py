"""A bundle written, compiled, read, searched and checked; memories through their states."""

import pytest

from skein.operators import authoring
from skein.operators.authoring import AuthoringError, Page
from skein.operators.storage import Files
from skein.wiki_api import Wiki, WikiError


def test_paths():
    assert authoring.page_path("a/b") == "a/b.md" and authoring.page_path("./x.MD") == "x.MD" and authoring.page_path(".hidden") == ".hidden.md"
    for bad, code in ((" ", "invalid_request"), ("/a", "path_outside_repository"), ("a/../b", "path_outside_repository"), ("a.txt", "invalid_request"), ("d/Index.md", "invalid_request"), ("log", "invalid_request"), ("a.", "invalid_request")):
        with pytest.raises(AuthoringError) as e:
            authoring.page_path(bad)
        assert e.value.code == code
    with pytest.raises(AuthoringError):
        authoring.relative_parts("./a", here=False)


def test_documents():
    assert authoring.parse_document("no front") == ({}, "no front")
    assert authoring.parse_document("---\r\na: 1\r\n---\r\nbody") == ({"a": 1}, "body")
    front = {"type": "note", "tags": ["x", "ü"], "extra": {"k": [1, 2]}}
    assert authoring.parse_document(authoring.render_document(front, "b\n")) == (front, "b\n")
    for bad in ("---\na: 1\n", "---\n- 1\n---\n", "---\na: [\n---\n"):
        with pytest.raises(AuthoringError) as e:
            authoring.parse_document(bad)
        assert e.value.code == "invalid_frontmatter"
    page = Page("note", title=" ", extensions={"x": 1})
    assert page.frontmatter({"title": "old", "x": 0, "y": 2}) == {"type": "note", "x": 1, "y": 2}
    assert authoring.default_body(None, "d/two-words_here.md") == "# Two Words Here\n"


@pytest.fixture(scope="module")
def wiki(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("wiki")
    w = Wiki(spark, str(base / "gen"), {})
    w.create_bundle("team", str(base / "team"), "1.0", "Team", "Welcome\n")
    w.create_page("team", "guides/setup", Page("guide", "Setup", "How to install", tags=["install"], extensions={"audience": "novice"}), "# Setup\nSee [run](run.md), [gone](gone.md) and [web](https://x.org).\n")
    w.create_page("team", "guides/run", Page("guide", "Run", "How to start"), "# Run\nBack to [setup](./setup.md#setup).\n")
    Files(spark, str(base / "team")).create("guides/log.md", "# 2024-05-01\n- wrote run\n# 2024-06-01\n- wrote setup\n")
    return w


def test_reads(spark, wiki):
    assert wiki.health() == {"ok": True, "projection_available": False}
    assert wiki.build_projection()["cache"] == "miss" and wiki.build_projection()["cache"] == "hit"
    row = wiki.list_bundles().first()
    assert (row["bundle_id"], row["concepts"], row["links"], row["broken"]) == ("team", 2, 4, 1)
    assert wiki.get_directory("team")["index_source"] == "authored" and wiki.get_directory("team")["body_markdown"] == "Welcome\n"
    assert wiki.get_directory("team", "guides")["concepts"] == ["guides/run", "guides/setup"]
    assert wiki.get_concept("team", "guides/run")["title"] == "Run"
    with pytest.raises(WikiError):
        wiki.get_concept("team", "nothing")
    assert [r["concept_id"] for r in wiki.search_concepts("novice").collect()] == ["guides/setup"]
    assert [r["source_id"] for r in wiki.get_backlinks("team", "guides/setup").collect()] == ["guides/run"]
    around = {(r["direction"], r["href"], r["status"]) for r in wiki.get_neighborhood("team", "guides/setup", 999).collect()}
    assert around == {("outgoing", "run.md", "resolved"), ("outgoing", "gone.md", "broken"), ("outgoing", "https://x.org", "external"), ("backlink", "./setup.md#setup", "resolved")}
    assert wiki.get_neighborhood("team", "guides/setup", 0).count() == 2
    assert [r["entry"] for r in wiki.get_recent_changes("team").collect()] == ["wrote setup", "wrote run"]
    assert wiki.get_recent_changes("team", "guides", 0).count() == 1 and wiki.get_recent_changes("team", "other").count() == 0
    assert [r["code"] for r in wiki.check_links("team").collect()] == ["broken_link"]
    good, found = wiki.validate_bundle("team", "recommended")
    assert good and found.count() == 0
    assert wiki.routes().where("kind = 'concept'").count() == 2
    assert wiki.store.sizes()["concepts"] > 0


def test_writes(spark, wiki):
    with pytest.raises(AuthoringError) as e:
        wiki.create_page("team", "guides/run.md", Page("guide"))
    assert e.value.code == "concept_exists"
    with pytest.raises(AuthoringError) as e:
        wiki.create_bundle("again", wiki.bundles["team"], "1.0")
    assert e.value.code == "bundle_exists"
    done = wiki.create_page("team", "new-page", Page("note", extensions={"kept": True}))
    again = wiki.populate_page("team", "new-page", Page("note", "New"), "text\n", done["content_hash"])
    content = Files(spark, wiki.bundles["team"]).read("new-page.md")
    assert authoring.parse_document(content) == ({"type": "note", "title": "New", "kept": True}, "text\n") and again["content_hash"] == authoring.content_hash(content)
    with pytest.raises(AuthoringError) as e:
        wiki.populate_page("team", "new-page", Page("note"), "", done["content_hash"])
    assert e.value.code == "write_conflict"
    assert wiki.get_concept("team", "new-page")["title"] == "New"  # reads see the write


def test_memory(wiki):
    source = [{"kind": "file", "reference": "a.py"}]
    for n, more in (("one", {}), ("two", {"supersedes": ["one"]})):
        assert wiki.record_memory("team", n, "semantic", f"Memory {n}", f"The cache is cold, {n}.", "me", "2024-01-01", source, **more)["status"] == "candidate"
    with pytest.raises(WikiError) as e:
        wiki.record_memory("team", "one", "episodic", "t", "b", "me", "2024-01-01", source)
    assert e.value.code == "memory_exists"
    with pytest.raises(WikiError):
        wiki.record_memory("team", "a/b", "semantic", "t", "b", "me", "2024-01-01", source)
    assert wiki.recall_memory("team", "cache").count() == 0  # candidates are not recalled
    for n in ("one", "two"):
        assert wiki.transition_memory("team", n, "active", "me", "2024-01-02", "checked")["verified_by"] == "me"
    assert {r["memory_id"] for r in wiki.recall_memory("team", "cache").collect()} == {"one", "two"}
    done = wiki.transition_memory("team", "one", "superseded", "me", "2024-01-03", "newer", "two")
    assert done["superseded_by"] == "two" and [h["to"] for h in done["history"]] == ["active", "superseded"]
    assert [r["memory_id"] for r in wiki.recall_memory("team", "cache", ["semantic"]).collect()] == ["two"]
    with pytest.raises(WikiError) as e:
        wiki.transition_memory("team", "one", "active", "me", "2024-01-04", "back")
    assert e.value.code == "invalid_memory_transition"
