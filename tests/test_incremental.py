"""Builds from stored artifacts and stable copies, against full builds."""

import glob
import os

import pytest

from skein.api import Graph
from skein.operators.artifacts import Artifacts
from skein.sources import code, scan, spool


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def tables(graph):
    return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (graph.nodes(), graph.edges())]


def artifacts(spark, root):
    return Artifacts(spark, f"{root}/artifacts", {"nodes": code.NODE_ROWS, "edges": code.EDGE_ROWS})


def test_only_changed_files_are_parsed_and_the_graph_is_that_of_a_full_build(spark, without_codegen, tmp_path):
    source, root = tmp_path / "src", tmp_path / "graph"
    write(source, {f"pkg/m{i}.py": f"import os\n\nclass C{i}:\n    def f(self, x):\n        return g{i}(x)\n\ndef g{i}(y):\n    return os\n" for i in range(12)})
    write(source, {"docs/a.md": "# A\ntext\n", "lib.rs": "fn main() {}", "[odd] {name}*.py": "x = 1\n"})
    graph = Graph(spark, str(root))
    first = graph.materialize(str(source))
    assert (first["cache"], first["parsed"], first["reused"]) == ("miss", 14, 0)
    write(source, {"pkg/m3.py": "def other():\n    return 1\n", "[odd] {name}*.py": "x = 2\ny = x\n", "new.py": "z = 1\n"})
    os.remove(source / "pkg/m4.py")
    assert {r["status"]: r["n"] for r in graph.plan(str(source))[0].groupBy("status").count().withColumnRenamed("count", "n").collect()} == {"added": 1, "modified": 2, "deleted": 1, "unchanged": 12}
    second = graph.materialize(str(source))
    assert (second["parsed"], second["reused"]) == (3, 11)
    full = Graph(spark, str(tmp_path / "full"))
    full.materialize(str(source))
    assert tables(graph) == tables(full)
    assert graph.materialize(str(source))["cache"] == "hit"
    write(source, {"pkg/m3.py": "import os\n\nclass C3:\n    def f(self, x):\n        return g3(x)\n\ndef g3(y):\n    return os\n"})
    assert graph.materialize(str(source))["parsed"] == 0  # as it was at first: its artifact is still there


def test_damaged_artifacts_are_parsed_again(spark, without_codegen, tmp_path):
    source, root = tmp_path / "src", tmp_path / "graph"
    write(source, {f"m{i}.py": f"def f{i}():\n    return {i}\n" for i in range(6)})
    graph = Graph(spark, str(root))
    graph.materialize(str(source))
    expected = tables(graph)
    store = artifacts(spark, root)
    part = glob.glob(f"{root}/artifacts/edges/{store.batches[0]}/part-*.parquet")[0]
    os.remove(part)
    write(source, {"m0.py": "def f0():\n    return 0  # again\n"})
    assert graph.materialize(str(source))["parsed"] > 1
    write(source, {"m0.py": "def f0():\n    return 0\n"})
    graph.materialize(str(source))
    assert tables(graph) == expected
    part = glob.glob(f"{root}/artifacts/nodes/{store.batches[-1]}/part-*.parquet")[0]
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 0xFF
    with open(part, "wb") as f:
        f.write(data)
    os.remove(f"{os.path.dirname(part)}/.{os.path.basename(part)}.crc")
    write(source, {"more.py": "q = 1\n"})
    assert graph.materialize(str(source))["parsed"] >= 1
    full = Graph(spark, str(tmp_path / "full"))
    full.materialize(str(source))
    assert tables(graph) == tables(full)


def test_compaction_and_collection_keep_what_is_needed(spark, without_codegen, tmp_path):
    source, root = tmp_path / "src", tmp_path / "graph"
    write(source, {"a.py": "a = 1\n", "b.py": "b = 1\n"})
    graph = Graph(spark, str(root))
    graph.materialize(str(source))
    write(source, {"a.py": "a = 2\n"})
    graph.materialize(str(source))
    store, needed = artifacts(spark, root), graph.store.read(spark, "manifest")
    assert len(store.batches) == 2 and store.collect(needed) == []
    before = {part: sorted(map(str, store.rows(part, store.usable(needed)).collect())) for part in ("nodes", "edges")}
    store.compact(needed)
    assert len(store.batches) == 1
    assert {part: sorted(map(str, store.rows(part, store.usable(needed)).collect())) for part in ("nodes", "edges")} == before
    assert store.collect(needed.where("false")) and store.batches == []


def spooled(spark, source, folder, **options):
    whole = lambda: scan.scan(spark, str(source)).where("status = 'source'")
    wanted = spark.createDataFrame(whole().select("path", "absolute_path", "language", "content_hash").collect())  # as the scan saw them
    return spool.spool(spark, wanted, str(folder), lambda: whole().select("path", "content"), **options)


@pytest.mark.parametrize("prefer_whole", [False, True])
def test_a_file_that_changes_while_it_is_copied_is_copied_again_or_refused(spark, without_codegen, tmp_path, prefer_whole):
    source = tmp_path / "src"
    files = {"a.py": "a = 1\n", "b.py": "b = 1\n", "c [x].py": "c = 1\n"}
    write(source, files)
    contents = lambda rows: {r["path"]: bytes(r["content"]).decode() for r in rows.collect()}
    assert contents(spooled(spark, source, tmp_path / "s1", prefer_whole=prefer_whole)) == files
    with pytest.raises(spool.UnstableSource, match="a.py"):  # it stays another one
        spooled(spark, source, tmp_path / "s2", prefer_whole=prefer_whole, before_check=lambda n: write(source, {"a.py": "a = 9\n"}))
    write(source, files)
    # another one while the first copy is checked, and while the second is made: the third is that of the scan
    again = spooled(spark, source, tmp_path / "s3", prefer_whole=prefer_whole, before_check=lambda n: write(source, {"a.py": "a = 9\n" if n == 0 else "a = 1\n"}))
    assert contents(again) == files
