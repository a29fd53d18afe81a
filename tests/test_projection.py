"""Tables brought up to date from changed pages, against a full compile."""

import os
import random

from skein.wiki_api import TABLES, Wiki


def rows(wiki):
    return {name: sorted(map(str, (df := wiki.store.read(wiki.spark, name)).select(sorted(df.columns)).collect())) for name in TABLES}


def page(rng, names):
    links = " ".join(f"[l{i}]({rng.choice(names)})" for i in range(rng.randrange(4)))
    return f"---\ntype: note\ntitle: T{rng.randrange(5)}\ntags: [a, b{rng.randrange(3)}]\n---\n# H{rng.randrange(3)}\n{links}\n\n## Part\ntext {rng.random()}\n\n# Citations\n1. [c](x.md) cited\n"


def test_random_edits_give_the_tables_of_a_full_compile(spark, without_codegen, tmp_path):
    rng, folder = random.Random(4), tmp_path / "team"
    spots = ["a.md", "b.md", "d/a.md", "d/b.md", "d/e/f.md", "d/e/g.md", "h/i.md"]
    targets = ["a.md", "/d/a.md", "d/", "/d/e/", "../b.md", "e/f", "/h", "/h/i.md#h1", "gone.md", "#part", "/d/e/f.md#h0", "https://x.org", "index.md", "../../../out.md", "/d/b"]

    def put(name, text):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    for name in spots[:5]:
        put(name, page(rng, targets))
    put("index.md", "---\nokf_version: '1.0'\n---\nWelcome\n")
    wiki = Wiki(spark, str(tmp_path / "gen"), {"team": str(folder)})
    assert wiki.build_projection()["cache"] == "miss" and wiki.build_projection()["cache"] == "hit"
    edits = [
        lambda: (put("d/e/g.md", page(rng, targets)), put("h/i.md", page(rng, targets))),  # a directory that links wait for
        lambda: (os.remove(folder / "d/e/f.md"), os.remove(folder / "d/e/g.md")),  # a directory goes
        lambda: (put("d/log.md", "# 2024-05-01\n- one\n"), put("d/index.md", "Listed\n"), put("a.md", "---\ntype: [\n---\nx\n")),
    ]
    for n, edit in enumerate(edits):
        edit()
        done = wiki.build_projection()
        assert done["cache"] == "mixed" and done["changed"] <= 3
        full = Wiki(spark, str(tmp_path / f"full{n}"), {"team": str(folder)})
        assert full.build_projection()["cache"] == "miss"
        assert rows(wiki) == rows(full)
