"""Quality, language and toxicity: exact search, odd inputs, and held-out accuracy on the driver's tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from skein.llm import common, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "123 !!", "ok", "日本語", "a" * 50_000, "x y " * 20_000]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "l", 0.5) for i, t in enumerate(ODD)] + [(0, None, None, None), (None, "null id", "l", 1.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")


def _held_out(spark, name, label):
    found = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in found.values())
    return [(labels[i], r["predicted"]) for i, r in found.items() if r["held_out"] and i in labels]


def test_quality_held_out(spark):
    pairs = _held_out(spark, "op3_quality_classifier", "quality")
    assert np.mean([a == b for a, b in pairs]) > 0.95
    assert all(b for a, b in pairs if a)  # good documents stay


def test_toxicity_held_out(spark):
    pairs = _held_out(spark, "op8_toxicity", "toxic")
    assert np.mean([a == b for a, b in pairs]) > 0.93


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.op7_language_id(spark, SF).collect() if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97


def test_kneser_ney_sums_to_one():
    model = langid.learn([("banana bandana", "a"), ("papaya pa", "b")] * 3)
    letters = sorted(set("banana bandana papaya pa") - {" "})
    for context in ("", "b", "ba", "ban", "zz"):
        for j in range(2):
            total = 0.0
            for c in [*letters, "\x03", "q"]:  # q stands for any other character
                run = context + c if c != "\x03" else context
                cost, _ = model.entropies([run])
                before = model.entropies([context])[0][0][j] if context else 0.0
                if c == "\x03":
                    p = math.exp(-(cost[0][j] - _prefix(model, context, j)))
                else:
                    p = math.exp(-(_prefix(model, run, j) - _prefix(model, context, j)))
                total += p
                assert before >= 0
            assert total == pytest.approx(1.0, abs=1e-6)


def _prefix(model, run, j):
    """Cost of a run's characters without its end."""
    return float(_costs(model, run)[: len(run), j].sum())


def _costs(model, run):
    hashes, owner, reach = langid._grams([run])
    contexts = langid._contexts([run])
    p = np.full((len(owner), len(model.languages)), model.base)
    for n in range(langid.ORDER):
        gain = langid._lookup(model.keys[n], model.gain[n], hashes[n], 0.0)
        weight = langid._lookup(model.context_keys[n], model.weight[n], contexts[n], 1.0)
        p = np.where((reach > n)[:, None], gain + weight * p, p)
    return -np.log(p)


def test_block_max_search_is_exact():
    r = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(30)]
    samples = [(i, " ".join(r.choice(vocabulary, r.integers(1, 8))) + (" vile" if i % 3 == 0 else " fine"), int(i % 3 == 0)) for i in range(1500)]
    index = toxicity.learn(samples, {0: 0.66, 1: 0.34}, z=-100.0, most_terms=40)
    index_terms = index.terms
    toxicity_terms = {t: i for t, i in index_terms.items()}
    vectors = np.zeros((len(samples), len(toxicity_terms)))
    for row, (_, text, _) in enumerate(samples):
        for t, w in index.query(Counter(toxicity.WORDS.findall(text))).items():
            vectors[row, t] = w
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    for _ in range(40):
        query = index.query(Counter(r.choice([*vocabulary, "vile"], 5).tolist()))
        if not query:
            continue
        q = np.zeros(len(toxicity_terms))
        for t, w in query.items():
            q[t] = w
        cosines = vectors @ (q / np.linalg.norm(q))
        rows, best = index.nearest(query)
        expected = np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12)))[: index.k]
        assert best == pytest.approx(cosines[expected][: len(best)])
        assert rows.tolist() == expected[: len(rows)].tolist()


def test_rare_toxic_words_count():
    r = np.random.default_rng(4)
    plain = [f"plain{i}" for i in range(200)]
    text = lambda *more: " ".join([*r.choice(plain, 12), *more])
    samples = [(i, text(), 0) for i in range(1000)] + [(1000 + i, text("vile" if i % 50 else "foul"), 1) for i in range(1000)]
    index = toxicity.learn(samples, {0: 0.9, 1: 0.1})
    assert "foul" in index.terms  # 20 of 1,000 toxic examples, never in others
    assert toxicity.Scorer(index).score(text("foul"))[0] > 0.5 > toxicity.Scorer(index).score(text())[0]


@pytest.mark.parametrize(("sf", "recall"), [("sf0.001", 0.35), ("sf0.01", 0.6)])
def test_toxicity_recall_by_folds(sf, recall):
    read = lambda name: pq.read_table(f"/root/testdata/{sf}/{name}.parquet").to_pylist()
    texts = {r["doc_id"]: r["text"] or "" for r in read("documents")}
    rows = [(r["doc_id"], texts[r["doc_id"]], r["toxic"]) for r in read("labels") if r["toxic"] in (0, 1) and r["doc_id"] in texts]
    pairs = []
    for fold in range(5):
        known = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 != fold]
        share = np.mean([y for *_, y in known])
        scorer = toxicity.Scorer(toxicity.learn(known, {0: 1 - share, 1: share}))
        pairs += [(y, scorer.score(text)[0] >= 0.5) for i, text, y in rows if zlib.crc32(str(i).encode()) % 5 == fold]
    assert np.mean([found for y, found in pairs if y]) >= recall
    assert np.mean([found for y, found in pairs if not y]) <= 0.03


def test_odd_rows(tables, odd):
    docs, labels = tables
    scored = quality.score(odd, quality.fit(docs, labels)).collect()
    toxic = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    found = langid.identify(odd, langid.fit(docs, docs)).collect()
    assert len(scored) == len(toxic) == len(found) == len(ODD) + 2
    assert all(0 <= r["score"] <= 1 for rows in (scored, toxic, found) for r in rows)
    by = {r["doc_id"]: r["lang_pred"] for r in found}
    assert by[1] == by[2] == by[3] == "und" and by[4] != "und" and by[5] != "und"


def test_without_labels(tables, odd):
    docs, labels = tables
    none = labels.where("doc_id < 0")
    assert {r["score"] for r in quality.score(odd, quality.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(docs, none)).collect()} == {0.0}
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(docs, docs.where("doc_id < 0"))).collect()} == {"und"}
    empty = docs.where("doc_id < 0")
    assert quality.score(empty, quality.fit(docs, labels)).count() == 0


def test_sample_is_bounded(tables):
    docs, labels = tables
    rows, counts = common.bounded_sample(docs, labels, "quality", 20, 1 << 14)
    assert Counter(y for *_, y in rows) <= Counter({0: 20, 1: 20}) and sum(counts.values()) == labels.count()
    assert rows == common.bounded_sample(docs.repartition(7), labels.repartition(3), "quality", 20, 1 << 14)[0]


def test_every_label_is_sampled(spark):
    docs = spark.createDataFrame([(i, "long " * 50 if i == 0 else f"text {i}", f"l{i}") for i in range(66)], "doc_id bigint, text string, lang string").coalesce(1)
    rows, counts = common.bounded_sample(docs, docs, "lang", 2, 64, cut=True)
    assert {y for *_, y in rows} == set(counts) == {f"l{i}" for i in range(66)}
    assert max(len(text) for _, text, _ in rows) <= 64


def test_votes_equal_plain_cosines(tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + [t for t in ODD if t]
    vectors = model.embed(texts).astype(float)
    for v, got in zip(vectors, model.score(texts), strict=True):
        cosines = [float(np.dot(v, w)) for w in model.vectors.astype(float)]
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: model.neighbours]
        votes = [(max(cosines[i], 0.0) ** 8 * model.weights[i], model.labels[i]) for i in near]
        expected = (sum(w * y for w, y in votes) + 0.05 * model.prior) / (sum(w for w, _ in votes) + 0.05) if np.abs(v).sum() else model.prior
        assert got == pytest.approx(expected, abs=2e-3)


def test_entropies_equal_plain_kneser_ney():
    samples = [("banana bandana ban", "a"), ("nab a cab", "a"), ("papaya pa pa", "b"), ("happy pap", "b")]
    model = langid._fit([(langid._runs(text), lang) for text, lang in samples])
    alphabet = {c for text, _ in samples for c in text if c != " "}
    for j, lang in enumerate(model.languages):
        counts = [Counter() for _ in range(langid.ORDER)]
        for text, own in samples:
            for run in text.split() if own == lang else []:
                s = f"\x02{run}\x03"
                for at in range(1, len(s)):
                    for n in range(min(at + 1, langid.ORDER)):
                        counts[n][s[at - n : at + 1]] += 1
        for n in range(langid.ORDER - 1):
            before = Counter(g[1:] for g in counts[n + 1])
            counts[n] = Counter({g: before[g] or min(c, 1) for g, c in counts[n].items()})
        for run in ("banana", "pap", "zz", "happyban", "a"):
            s, cost = f"\x02{run}\x03", 0.0
            for at in range(1, len(s)):
                p = 1 / (len(alphabet) + 2)
                for n in range(min(at + 1, langid.ORDER)):
                    own = {g: c for g, c in counts[n].items() if g[:-1] == s[at - n : at]}
                    if own:
                        total = sum(own.values())
                        p = max(own.get(s[at - n : at + 1], 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(own) / total * p
                cost -= math.log(p)
            assert model.entropies([run])[0][0][j] == pytest.approx(cost)


def test_letters_are_unicode_letters(spark):
    model = langid.learn([("wort haus", "de"), ("word house", "en")] * 4)
    texts = ["½ ² Ⅷ", "x²y", "١٢٣", "日本", None]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(rows, key=lambda r: r["doc_id"])] == [True, False, True, False, True]
    assert langid._runs("x²y ab") == ["x", "y", "ab"]


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)] + [(0, "text 0"), (1, "another")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(0, 0), (3, 0)], "doc_id bigint, y int")
    rows, _ = common.bounded_sample(docs, labels, "y", 20, 100)
    assert rows == [(0, "text 0", 0), (1, "another", 1), (2, "text 2", 0), (3, "text 3", 0), *[(i, f"text {i}", i % 2) for i in range(4, 9)]]
    few, _ = common.bounded_sample(docs, labels, "y", 20, 100, most_bytes=40)
    assert 0 < len(few) < len(rows)


def test_workers_need_no_copy_of_the_package(spark):
    """Models travel with their classes; this session's workers start where the package can't be found."""
    import os

    def found(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"there": [importlib.util.find_spec("skein") is not None]})

    if "PYTHONPATH" not in os.environ:
        assert not spark.range(1).mapInArrow(found, "there boolean").first()["there"]
    for name in ("op3_quality_classifier", "op7_language_id", "op8_toxicity"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
