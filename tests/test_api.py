"""From files to answers."""

import pytest

from skein.api import ApiError, Graph


def test_build_and_ask(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "service.py").write_text("class SampleService:\n    def helper(self):\n        return run()\n\ndef run():\n    return 1\n")
    (source / "notes.txt").write_text("x")
    (source / "guide.md").write_text("# Guide\nabout it\n")
    (source / "lib.rs").write_text("fn main() {}")
    g = Graph(spark, str(tmp_path / "graph"))
    assert g.health() == {"ready": False}
    assert {r["status"] for r in g.plan(str(source))[0].collect()} == {"added"}
    assert g.materialize(str(source))["cache"] == "miss" and g.materialize(str(source))["cache"] == "hit"
    assert g.plan(str(source))[1].first().asDict() == {"scanned": 4, "ignored": 0, "unsupported": 1, "rebuilt": 0, "skipped": 3, "deleted": 0}
    top = g.search("SampleService").first()
    assert top["node_type"] == "Class"
    around = g.context(top["id"], limit=10).collect()
    assert any(r["relation"] == "Contains" for r in around)
    hits = g.search_with_context("SampleService helper", limit=3, context_limit=4)
    assert [h["id"] for h in hits] == [r["id"] for r in g.search("SampleService helper", limit=3).orderBy("position").collect()] and {h["state"] for h in hits} == {"ready"}
    for h in hits:
        alone = g.context(h["id"], limit=4).orderBy("position").collect()
        assert h["context"] == [r.asDict() for r in alone]
    assert all(r["layer"] == "syntax" for r in g.search("helper", layer="syntax", limit=5).collect())
    assert g.query("MATCH (n:Class) RETURN n.label")["rows"] == [["SampleService"]]
    assert g.ask("symbol_lookup", name="run").count() >= 1 and g.health()["nodes"] > 5
    assert g.query("MATCH (n:DocumentationChunk) RETURN n.label")["rows"] == [["Guide"]]
    assert {r["label"] for r in g.nodes().where("node_type = 'File'").collect()} == {"service.py", "guide.md", "lib.rs"}
    assert {r["message"] for r in g.diagnostics(str(source)).collect()} == {"Skipped unsupported file notes.txt", "No parser for rust: lib.rs"}
    import shutil

    assert g.health(verify=True)["damaged"] == {}
    shutil.rmtree(f"{g.root}/{g.store.current()['generation']}/edges")
    assert {(h["state"], len(h["context"])) for h in g.search_with_context("SampleService")} == {("degraded", 0)}
    with pytest.raises(ApiError):
        g.search(" ")
    with pytest.raises(ApiError):
        g.context("x", profile="none")
