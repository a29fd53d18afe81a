"""Patterns, bundles, scans, generations and the change stream: the fixtures' cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import changes, generations, graph, manifest, search, wiki
from skein.plans import named
from skein.plans.patterns import PatternError, check_read_only, compile_pattern, run_pattern
from skein.sources import bundle, chunks, markdown, scan
from skein.streaming import refresh


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("f:a", "Function", "alpha", "m.alpha", "a.py"), ("f:b", "Function", "beta", "m.beta", "b.py"), ("c:1", "CallExpression", "beta()", "m.beta()", "a.py"), ("c:2", "CallExpression", "gone()", "m.gone()", "a.py"), ("r:1", "Reference", "lost", "m.lost", "a.py")], "id string, node_type string, label string, qualified_name string, path string")
    edges = spark.createDataFrame([("e1", "Calls", "f:a", "c:1", None), ("e2", "ResolvesTo", "c:1", "f:b", None), ("e3", "Calls", "f:a", "c:2", 1)], "id string, edge_type string, source_id string, target_id string, child_index bigint")
    return nodes, edges


def test_patterns(small):
    nodes, edges = small
    found = compile_pattern("MATCH (c:CallExpression)-[:FROM_ResolvesTo]->(:ResolvesTo)-[:TO_ResolvesTo]->(t) RETURN c.id, t.id, t.label LIMIT 5", nodes, edges)
    assert found.columns == ["c_id", "t_id", "label"] and [tuple(r) for r in found.collect()] == [("c:1", "f:b", "beta")]
    lost = compile_pattern("MATCH (c:CallExpression) WHERE NOT EXISTS { MATCH (c)-[:ResolvesTo]->(x) } RETURN c.id", nodes, edges)
    assert [r[0] for r in lost.collect()] == ["c:2"]
    assert run_pattern("MATCH (n) RETURN n.id", nodes, edges, limit=1)["truncated"] is True
    assert run_pattern("MATCH (f {path: $path}) RETURN f.id AS i", nodes, edges, {"path": "b.py"})["rows"] == [["f:b"]]
    assert compile_pattern("MATCH (a)<-[:Calls]-(b) RETURN count(a)", nodes, edges).first()[0] == 2


@pytest.mark.parametrize("statement", ["MATCH (n) DELETE n", "MATCH (n) WHERE n.label = 'drop' RETURN n.id", "MATCH (n) RETURN n.id; MATCH (m) RETURN m.id"])
def test_read_only(statement):
    with pytest.raises(PatternError):
        check_read_only(statement)


def test_read_only_words():
    assert check_read_only("MATCH (n) RETURN n.offset ;") == "MATCH (n) RETURN n.offset "
    with pytest.raises(PatternError):
        compile_pattern("MATCH (n) RETURN upper(n.id)", None, None)


def test_named_questions(small):
    nodes, edges = small
    assert named.ask("unresolved_references", nodes, edges).count() == 1
    assert {r["label"] for r in named.ask("symbol_lookup", nodes, edges, name="m.beta").collect()} == {"beta"}
    assert len(named.CATALOG) == 23 and set(named.GROUPS) <= {q.group for q in named.CATALOG.values()}
    for name, question in named.CATALOG.items():
        named.ask(name, nodes, edges, **dict.fromkeys(question.parameters, "alpha")).collect()
    with pytest.raises(KeyError, match="known"):
        named.groups("nothing")


def test_context(small):
    nodes, edges = small
    rows = graph.context(nodes, edges, "f:a", ["Calls", "ResolvesTo"], limit=5, max_depth=2).collect()
    assert [(r["direction"], r["relation"], r["neighbor_id"]) for r in rows] == [("outgoing", "Calls", "c:2"), ("outgoing", "Calls", "c:1"), ("incoming", "Calls", "f:a"), ("outgoing", "ResolvesTo", "f:b")]
    assert graph.context(nodes, edges, "f:a", ["Calls"], limit=0).count() == 0


def test_merge_keeps_the_first_text_and_fills_the_rest(spark):
    rows = spark.createDataFrame([("s", 0, "", None, "first", "one", "{}"), ("s", 1, "second", 42, "other", "two", '{"a": 1}')], "id string, at int, label string, line int, summary string, text string, metadata string")
    got = graph.merge_first(rows, ["id"], "at", ["label", "summary"], ["line"], ["text"], ["metadata"]).first()
    assert (got["label"], got["line"], got["summary"], got["text"], got["metadata"]) == ("second", 42, "first", "one", '{"a": 1}')


def test_search_fixture(spark):
    docs = spark.createDataFrame([("fn:a", "semantic", 0, "alpha"), ("fn:b", "semantic", 0, "alpha"), ("fn:c", "semantic", 0, "unrelated"), ("fn:u", "semantic", 0, "ÜberService"), ("s", "syntax", 1, None)], "id string, layer string, index_order int, text string")
    index = search.build_index(docs)
    assert [r["id"] for r in search.top(search.bm25(index, "alpha"), 5).collect()] == ["fn:a", "fn:b"]
    assert [r["id"] for r in search.top(search.bm25(index, "überservice"), 1).collect()] == ["fn:u"]
    assert search.bm25(index, "").count() == 0 and index.problems().count() == 0
    assert search.query_terms("A b a _c 1") == ["a", "b", "_c", "1"]


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([("a", "semantic", 0, "x y y")], "id string, layer string, index_order int, text string")
    stored = search.build_index(docs).write(str(tmp_path))
    assert stored.problems().count() == 0 and {r["term"]: r["tf"] for r in stored.postings.collect()} == {"x": 1, "y": 2}


def test_weighted_search(spark):
    rows = [("north", "harbour-plan", "plan", "Harbour Dredging Plan", "Tides and depth", ["sea", "works"], ["Depth"], "Beware of <b>currents</b> here"), ("north", "crane-log", "plan", "Crane Log", "Loads", ["works"], [], "text"), ("south", "sketch", "draft", "Sketch", None, ["sea"], [], "tides and depth")]
    docs = spark.createDataFrame(rows, "bundle_id string, concept_id string, type string, title string, description string, tags array<string>, headings array<string>, body string")
    docs = docs.withColumns({"extensions": F.array().cast("array<string>"), "citations": F.array().cast("array<string>")})
    best = lambda q, **k: search.weighted_search(docs, q, **k).first()
    assert best("harbour dredging plan")["concept_id"] == "harbour-plan" and best("crane-log")["score"] >= 1000
    assert best("tides and depth")["concept_id"] == "harbour-plan"
    assert search.weighted_search(docs, "harbour", bundle="north", kind="plan", tags=["sea"]).count() == 1
    assert best("currents")["snippet"] == "Beware of &lt;b&gt;<mark>currents</mark>&lt;/b&gt; here"


def test_snippets_cut_no_character(spark):
    texts = ["é" * 30 + "a needle " + "ж" * 40, "needle", "x" * 60 + "NEEDLE" + "€" * 30, "日" * 20 + "needle" + "a" + "日" * 20, None, "none"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(search.mark(F.col("t"), "needle", [])).collect()]

    def plain(t):
        data, at = (t or "").encode(), (t or "").lower().encode().find(b"needle")
        if at < 0:
            return None
        return (data[max(0, at - 48) : at].decode(errors="ignore") + "<mark>" + data[at : at + 6].decode() + "</mark>" + data[at + 6 : at + 54].decode(errors="ignore"))[:160]

    assert found == [plain(t) for t in texts]


def test_terms_are_the_same_in_index_and_query(spark):
    texts = ["cafe\u0301 Café _a1 ½x Ⅷ", "ΣΑΣ İstanbul straße STRASSE", "x" * 300 + " " + "é" * 130, "a-b c.d 日本語 किताब", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.code_terms(F.col("t")).alias("terms")).collect()
    for r in rows:
        assert r["terms"] == X.plain_code_terms(r["t"])
    assert rows[0]["terms"][:2] == ["cafe", "café"] and rows[1]["terms"][0] == "σασ" and len(rows[2]["terms"][1].encode()) == 256


def test_globs(spark):
    paths = ["docs2/x", "docs/x", "a/éb", "a/xb", "lib/skip/y"]
    one = lambda p: {r[0] for r in spark.createDataFrame([(x,) for x in paths], "p string").where(X.matches_glob(F.col("p"), p)).collect()}
    assert one("docs/") == {"docs2/x", "docs/x"} and one("./docs\\*") == {"docs/x"} and one("?b") == {"a/xb"} and one("??b") == {"a/éb"} and one("# docs/") == set()


def test_assignments_by_owner(spark):
    rows = spark.createDataFrame([("ÄB_1", "Module", "Constant"), ("self.y", "Class", "ClassAttribute"), ("self.y", "Method", "InstanceAttribute"), ("x", "Class", "ClassAttribute"), ("_", "Module", "Variable"), ("ABc", "Module", "Variable")], "t string, o string, k string")
    from skein.sources import code

    assert all(r[0] == r[1] for r in rows.select("k", code.target_kind(F.col("t"), F.col("o"))).collect())


def test_text_functions(spark):
    one = lambda **c: spark.range(1).select(*[e.alias(n) for n, e in c.items()]).first()
    r = one(a=X.normalize_path(F.lit("guide"), F.lit("../x/./y.md")), b=X.normalize_path(F.lit("guide"), F.lit("../../out")), c=X.normalize_path(F.lit("g"), F.lit("/a//b")), d=X.slug(F.lit("Deep -- Dive!")), e=X.link_scheme(F.lit("javascript:x")), f=X.link_scheme(F.lit("a/b:c")), g=X.ancestors(F.lit("a/b")), h=X.block_value(F.lit("a b")), i=X.percent_encode(F.lit("a b/ä")), j=X.cut_bytes(F.lit("é" * 200)))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("x/y.md", None, "a/b", "deep-dive", "javascript", None)
    assert r["g"] == ["", "a", "a/b"] and r["h"] == '"a b"' and r["i"] == "a%20b%2F%C3%A4" and r["j"] == "é" * 128
    assert X.fnv1a(b"") == 0xCBF29CE484222325 and one(p=X.partition_id(F.lit("src/lib.rs")))["p"] == "b24749917179fb5e3e61"
    assert one(p=X.graph_id("Module", F.lit("abc")))["p"] == "Module:a9993e364706816aba3e"


def test_scan(spark, tmp_path):
    for name in ("service.py", "notes.txt", "ignored.py", "src/cli/build/mod.rs", "node_modules/x.js", "docs/a.MD"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "rules").write_text("# comment\n\nignored.py\n")
    rules = scan.read_rules(spark, str(tmp_path / "rules"))
    found = {r["path"]: r for r in scan.scan(spark, str(tmp_path), ignore=rules).drop("content").collect()}
    assert {p: r["status"] for p, r in found.items()} == {"service.py": "source", "notes.txt": "unsupported", "ignored.py": "ignored", "src/cli/build/mod.rs": "source", "docs/a.MD": "source", "rules": "unsupported"}
    assert found["docs/a.MD"]["language"] == "markdown" and len(found["service.py"]["content_hash"]) == 64 and found["notes.txt"]["content_hash"] == ""


def test_manifest(spark):
    now = spark.createDataFrame([("a", "1", "python", "k1"), ("b", "2", "rust", "k2")], "path string, content_hash string, language string, artifact_key string")
    old = spark.createDataFrame([("a", "0", "python", "k1"), ("c", "3", "go", None)], now.schema)
    assert {r["path"]: r["status"] for r in manifest.diff(now, old).collect()} == {"a": "modified", "b": "added", "c": "deleted"}
    assert {r["status"] for r in manifest.diff(now, None).collect()} == {"added"}
    assert manifest.needs_full_build(old, {"v": 1}, {"v": 1}) and not manifest.needs_full_build(now, {"v": 1}, {"v": 1})


def test_generations(spark, tmp_path):
    store = generations.Store(str(tmp_path), keep=1)
    t = {"nodes": spark.range(3)}
    first = store.publish(t, digest="a")
    assert store.publish(t, digest="a")["cache"] == "hit" and store.read(spark, "nodes").count() == 3
    held = store.lease()
    old = store.next_sequence()
    store.publish({"nodes": spark.range(5)}, store.next_sequence(), digest="b")
    assert (tmp_path / first["generation"]).exists()
    with pytest.raises(generations.StaleGeneration):
        store.publish(t, old)
    with pytest.raises(ZeroDivisionError):
        store.publish({"nodes": spark.range(9)}, validate=lambda tables: 1 / 0)
    assert store.read(spark, "nodes").count() == 5
    other = generations.Store(str(tmp_path), keep=1)
    other.publish({"nodes": spark.range(6)}, digest="c")
    assert (tmp_path / first["generation"]).exists()  # leased by another object
    store.release(held)
    assert first["generation"] in store.collect() and other.read(spark, "nodes").count() == 6


def test_tables_from_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", "semantic", 0, "x y y"), ("b", "syntax", 1, None)], "id string, layer string, index_order int, text string")
    store = generations.Store(str(tmp_path))
    store.publish({"docs": docs, **search.index_tables(lambda written: written["docs"])})
    index = search.Index(*(store.read(spark, p) for p in search.PARTS))
    assert index.problems().count() == 0 and {(r["id"], r["length"]) for r in index.lengths.collect()} == {("a", 3), ("b", 0)}
    assert search.store_index(docs, f"file://{tmp_path}/index").problems().count() == 0
    nodes = spark.createDataFrame([("a", "File")], "id string, node_type string")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string")
    broken = {p: store.read(spark, p) for p in search.PARTS} | {"nodes": nodes, "edges": edges}
    generations.check_bundle(broken)
    broken["totals"] = broken["totals"].withColumn("n", F.col("n") + 1)
    with pytest.raises(ValueError, match="totals"):
        generations.check_bundle(broken)


FRONT = "---\ntype: decision\ntitle: One\ntags: [rust, okf]\nscore: 7\ncustom:\n  owner: ann\n---\n# Body\n"


def test_bundle(spark, tmp_path):
    files = {"b/decisions/adr.md": FRONT, "b/index.md": "---\nokf_version: '0.1'\ntitle: T\n---\n", "b/bad/none.md": "text", "b/bad/yaml.md": "---\ntype: x\na: [\n---\n", "b/bad/untyped.md": "---\ntitle: y\n---\n", "b/nested/index.md": "---\ntitle: z\n---\n", "b/log.md": "---\na: 1\n---\n", "b/bad/tag.md": "---\ntype: n\nx: !!python/object {}\n---\n", "b/bad/version.md": "---\ntype: n\ntitle: t\ndescription: d\nokf_version: 1.0\n---\n"}
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    entries = bundle.read(spark, str(tmp_path)).cache()
    one = {r["source_path"]: r for r in entries.collect()}
    adr = one["decisions/adr.md"]
    assert (adr["bundle_id"], adr["kind"], adr["type"], adr["tags"], adr["body_markdown"], adr["body_start_line"]) == ("b", "concept", "decision", ["rust", "okf"], "# Body\n", 9)
    assert json.loads(adr["extensions"]) == {"custom": {"owner": "ann"}, "score": 7} and one["index.md"]["okf_version"] == "0.1"
    found = {(r["source_path"], r["code"]): r["line"] for r in wiki.conformance(entries).collect()}
    assert found["bad/none.md", "missing_frontmatter"] == 1 and found["bad/untyped.md", "missing_type"] == 1
    assert found["bad/yaml.md", "invalid_frontmatter"] >= 3 and found["bad/tag.md", "invalid_frontmatter"] == 3
    assert found["nested/index.md", "reserved_frontmatter"] == 2 and found["log.md", "reserved_frontmatter"] == 2
    accepted = wiki.acceptance(entries, wiki.conformance(entries)).first()
    assert (accepted["consume"], accepted["conformant"], accepted["recommended"]) == (True, False, False)


def test_markdown(spark):
    body = "intro\n# Guide\ntext [t](target.md#there) ![i](x.png)\n```\n# no heading\n```\n## Deep *Dive*\n## Deep Dive\n# Citations\n1. [One](a.md)\n   more\n2. two\n# After\n- no\n"
    docs = spark.createDataFrame([(1, body), (2, "plain"), (3, ""), (4, None)], "id int, text string")
    assert [(r["id"], r["heading"], r["line_start"]) for r in markdown.sections(docs, ["id"]).orderBy("id", "line_start").collect()][:2] == [(1, "Guide", 2), (1, "no heading", 5)]
    assert [r["slug"] for r in markdown.headings(docs, ["id"]).orderBy("position").collect()] == ["guide", "deep-dive", "deep-dive-2", "citations", "after"]
    assert [(r["href"], r["context"]) for r in markdown.links(docs.where("id = 1"), ["id"]).orderBy("position").collect()] == [("target.md#there", "t"), ("a.md", "One")]
    assert [(r["number"], r["citation"], r["href"]) for r in markdown.citations(docs, ["id"]).orderBy("line").collect()] == [(1, "[One](a.md) more", "a.md"), (2, "two", None)]
    log = spark.createDataFrame([("guides", "- lost\n## 2026-07-30\n### Decisions\n- Added [a](b.md)\n  and more\n## 2026-07-29\n- Earlier draft\n")], "scope string, text string")
    entries = markdown.log_entries(log, ["scope"]).orderBy("line").collect()
    assert [(r["date"], r["category"], r["entry"], r["hrefs"]) for r in entries] == [(None, "update", "lost", []), ("2026-07-30", "Decisions", "Added [a](b.md) and more", ["b.md"]), ("2026-07-29", "update", "Earlier draft", [])]


def test_links(spark):
    links = spark.createDataFrame([("docs", "guide/intro", h) for h in ("missing.md", "../target.md#not-there", "../target.md#There", "https://e.example", "javascript:alert(1)", "../../out.md", "#deep-dive", "./", "", "../guide/", "outro")], "bundle_id string, source_id string, href string")
    concepts = spark.createDataFrame([("docs", "guide/intro"), ("docs", "target")], "bundle_id string, concept_id string")
    slugs = spark.createDataFrame([("docs", "target", "there"), ("docs", "guide/intro", "deep-dive")], "bundle_id string, concept_id string, slug string")
    got = {r["href"]: (r["status"], r["target_id"]) for r in wiki.resolve_links(links, concepts, slugs).collect()}
    assert got["missing.md"] == ("broken", "bundle:docs:concept:guide/missing") and got["../target.md#not-there"][0] == "broken"
    assert got["../target.md#There"] == ("resolved", "bundle:docs:concept:target") and got["#deep-dive"] == ("resolved", "bundle:docs:concept:guide/intro")
    assert got["./"] == got["../guide/"] == ("resolved", "bundle:docs:directory:guide")
    assert [got[h][0] for h in ("https://e.example", "javascript:alert(1)", "../../out.md", "", "outro")] == ["external", "rejected", "rejected", "rejected", "broken"]


def test_capped_debounce(spark):
    at = [dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=m) for m in (0, 100, 200, 300, 400, 1000, 1100)]
    rows = spark.createDataFrame([("k", t, i, f"p{i % 2}", False) for i, t in enumerate(at)], "key string, ts timestamp, event_id int, path string, rescan boolean")
    batches = {r["event_id"]: r["batch"] for r in changes.capped(rows, 0.25, 0.35).collect()}
    assert [batches[i] for i in range(7)] == [1, 1, 1, 1, 2, 3, 3]
    found = changes.coalesce_batches(changes.capped(rows, 0.25, 0.35), most_paths=1).orderBy("batch").collect()
    assert [(r["event_count"], r["paths"], r["full_rescan"]) for r in found] == [(4, [], True), (1, ["p0"], False), (2, [], True)]


def test_refresh_helpers(spark):
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert refresh.with_retry(flaky, lambda e: isinstance(e, OSError), sleep=waits.append) == "done" and waits == [0.1, 0.2]
    with pytest.raises(ValueError):
        refresh.with_retry(lambda: (_ for _ in ()).throw(ValueError()), lambda e: isinstance(e, OSError))
    lease = refresh.Coordinator()
    ticket, work = lease.submit({"a"})
    assert work == {"a"} and lease.submit({"b"}) is None and not lease.finish(99) and lease.finish(ticket)
    assert lease.submit(set())[1] == {"b"}
    assert refresh.is_transient(OSError("Resource busy: lock")) and not refresh.is_transient(ValueError("bad"))


def test_labels(spark):
    rows = spark.createDataFrame([(" a\nb ", "a b"), ("x", "x")], "t string, c string")
    assert all(r[0] == r[1] for r in rows.select(X.clean_label(F.col("t")), "c").collect())
    rows = spark.createDataFrame([("a: int = 3", "a"), ("b=1", "b"), ("*rest", "rest"), ("**more: dict", "more"), ("plain", "plain"), (" c : int ", "c")], "t string, p string")
    assert all(r[0] == r[1] for r in rows.select(X.parameter_label(F.col("t")), "p").collect())


def test_chunks(spark, tmp_path):
    assert chunks.chunk_names(["n__000002.json", "n.json", "m.json", "n__000001.json", "n__1.json"], "n") == ["n.json", "n__000001.json", "n__000002.json"]
    with pytest.raises(ValueError, match="lacks chunk 1"):
        chunks.chunk_names(["n.json", "n__000002.json"], "n")
    (tmp_path / "n.json").write_text('[{"id": "a"}, {"id": "b"}]')
    (tmp_path / "n__000001.json").write_text('[{"id": "c"}]')
    assert sorted(r["id"] for r in chunks.read_chunks(spark, str(tmp_path), "n", "id string").collect()) == ["a", "b", "c"]
    assert chunks.read_chunks(spark, str(tmp_path), "none", "id string").count() == 0


def test_artifact_store(spark, tmp_path):
    path = str(tmp_path / "cache")
    made = lambda *rows: spark.createDataFrame([(k, v.encode()) for k, v in rows], "artifact_key string, payload binary")
    content = lambda df: {r["artifact_key"]: bytes(r["payload"]) for r in df.collect()}
    assert content(manifest.store_artifacts(made(("a", "1"), ("a", "1"), ("b", "2")), path)) == {"a": b"1", "b": b"2"}
    assert content(manifest.store_artifacts(made(("a", "other"), ("c", "3")), path)) == {"a": b"1", "b": b"2", "c": b"3"}
    damaged = spark.createDataFrame([("d", b"x", "wrong")], "artifact_key string, payload binary, payload_hash string")
    damaged.write.mode("append").parquet(path)
    assert content(manifest.store_artifacts(made(("d", "4")), path))["d"] == b"4"


def test_paths_are_checked(spark):
    rows = spark.createDataFrame([("a/b", True, "a/b"), ("/a", False, None), ("\\a", False, None), ("c:x", False, None), ("a/../b", False, None), ("a..b/c", True, "a..b/c"), ("./a//b/.", True, "a/b"), ("a\\b", True, "a/b"), ("x/c:d", True, None)], "p string, safe boolean, inside string")
    assert all(r[0] == r["safe"] and r[1] == r["inside"] for r in rows.select(X.is_safe_path(F.col("p")), X.repository_path(F.col("p")), "safe", "inside").collect())
    one = spark.createDataFrame([('{"b": "x", "a": [1, "y", {"q": 1}, true, [2], null], "n": 1.5, "o": {"z": 1}, "t": null}',)], "e string")
    assert one.select(X.extension_terms(F.col("e"))).first()[0] == ["a 1", "a true", "a y", "b x", "n 1.5"]
