"""Packing, training-order shards and the word cache, against plain versions."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from skein.llm import packing, tokenstore
from skein.llm.words import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world! it's DON'T ÀÉ", None, "", " \n\t", "<|endoftext|> foo<|endoftext|>bar", "İstanbul ΣΑΣ ² ½x a\x1cb c\x85d", "日本語 テキスト한국어", "a" * 400, "one two three " * 700, "same text", "same text", "x́y é é", "foo_bar __ 'sx x's a…b “q” 12,34"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, length int").repartition(3)


@pytest.fixture(scope="module")
def expected():
    tokenizer = WordIds(PATH).tokenizer
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}


def test_word_ids_equal_the_tokenizer(expected):
    got = WordIds(PATH, most_words=3).encode(TEXTS) + WordIds(PATH).encode(TEXTS)
    for i, data in enumerate(got):
        assert [*np.frombuffer(data, "<u4").tolist(), 1] == expected[i % len(TEXTS)]


def test_packing(docs, expected):
    packed = packing.pack(docs, PATH, capacity=256)
    rows = packed.placement.collect()
    for r in rows:
        ids = expected[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(map(len, expected.values()))
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    sequences = {r["sequence_id"]: len(r["ids"]) // 4 for r in packed.sequences().collect()}
    assert sequences == {k: sum(n for _, n in v) for k, v in by.items()}


def _brute(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_plan_is_near_the_optimum():
    r = np.random.default_rng(3)
    for _ in range(40):
        lengths = sorted(r.integers(1, 21, r.integers(1, 9)).tolist(), reverse=True)
        plan = packing.plan(dict(Counter(lengths)), 20)
        placed = Counter()
        for p in plan:
            assert sum(a * n for a, n in p.items) <= 20
            for a, n in p.items:
                placed[a] += n * p.count
        assert placed == Counter(lengths)
        assert sum(p.count for p in plan) <= _brute(lengths, 20) + (len(lengths) > 6)
    assert packing.plan({}, 20) == []


def test_plan_with_thousands_of_small_pieces():
    counts = {3000: 10, 1: 1200}
    placed = Counter()
    plan = packing.plan(counts, 4096)
    for p in plan:
        assert sum(a * n for a, n in p.items) <= 4096
        for a, n in p.items:
            placed[a] += n * p.count
    assert placed == counts and sum(p.count for p in plan) == 10


def test_empty_tables(spark, docs):
    none = docs.where("doc_id < 0")
    assert packing.pack(none, PATH).placement.count() == 0
    store = tokenstore.build(none, PATH, "k")
    assert store.n == 0 and store.index.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    slots = tokenstore.permute(np.arange(n), n, "key")
    assert sorted(slots.tolist()) == list(range(n))
    assert (tokenstore.permute(slots, n, "key", inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (tokenstore.permute(np.arange(n), n, "other") != slots).mean() > 0.9


def test_training_order_round_trip(spark, docs, expected):
    store = tokenstore.build(docs, PATH, "key", stride=16, per_shard=8, waves=3)
    index, ids = {r["slot"]: r for r in store.index.collect()}, {r["slot"]: bytes(r["ids"]) for r in store.read(spark).collect()}
    assert sorted(index) == sorted(ids) == list(range(store.n))
    seen = Counter()
    for slot, r in index.items():
        own = np.frombuffer(ids[slot], "<u2")[: r["n_ids"]].tolist()
        assert own == expected[r["doc_id"]][r["piece"] * 16 : r["piece"] * 16 + 16]
        assert not any(ids[slot][2 * r["n_ids"] :])
        seen[r["doc_id"]] += r["n_ids"]
    assert seen == {i: len(v) for i, v in expected.items()}
    again = tokenstore.build(docs, PATH, "key", stride=16, per_shard=8, waves=3, path=store.path, resume=True)
    assert {r["slot"]: r["ids_crc32"] for r in again.checksums(spark).collect()} == {s: zlib.crc32(b) for s, b in ids.items()}


def test_best_bins_equal_brute_force():
    r = np.random.default_rng(11)
    improved = 0
    for _ in range(400):
        capacity = int(r.integers(8, 40))
        lengths = r.integers(1, capacity // 2 + 1 if r.random() < 0.7 else capacity + 1, r.integers(1, 10)).tolist()
        solved = packing.solve(dict(Counter(lengths)), capacity)
        least = _brute(sorted(lengths, reverse=True), capacity)
        assert solved.proven and solved.bound <= solved.sequences == least
        improved += sum(p.count for p in packing._best_fit(dict(Counter(lengths)), capacity)) > least
    assert improved  # the search found better packings than best fit


def test_search_betters_best_fit():
    r = np.random.default_rng(3)
    better = 0
    for _ in range(6):
        counts = dict(Counter(r.integers(700, 2200, 60).tolist()))
        solved = packing.solve(counts, 4096, nodes=2000)
        better += solved.sequences < sum(p.count for p in packing._best_fit(counts, 4096))
        assert solved.bound <= solved.sequences
    assert better


@pytest.mark.parametrize(("counts", "least"), [({2049: 10, 1: 2047}, 10), ({3: 1863226}, 1366), ({4096: 5, 1: 1}, 6)])
def test_many_equal_pieces(counts, least):
    solved = packing.solve(counts, 4096)
    placed = Counter()
    for p in solved.patterns:
        assert sum(a * n for a, n in p.items) <= 4096
        for a, n in p.items:
            placed[a] += n * p.count
    assert placed == counts and solved.proven and solved.sequences == least


def test_pieces_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, 0, 5, 7, 3, 4, 5, 6, "x")], "doc_id bigint, piece int, length bigint, ids_crc32 bigint, salt int, rank int, before int, at int, Offset string")
    placed = packing.place(rows, 10).first()
    assert (placed["salt"], placed["rank"], placed["before"], placed["at"], placed["offset"]) == (3, 4, 5, 6, 0)


def test_numbers_follow_files_and_rows(spark, docs, tmp_path):
    docs.sortWithinPartitions("doc_id").write.parquet(f"file://{tmp_path}/docs")
    seen = []
    for most in (128 << 20, 900):  # whole files in few partitions, then many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        store = tokenstore.build(spark.read.parquet(f"file://{tmp_path}/docs"), PATH, "key", stride=16, per_shard=64)
        seen.append({tuple(r) for r in store.index.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and sorted(r[3] for r in seen[0]) == list(range(len(seen[0])))


def test_resume_needs_the_same_order(spark, docs):
    store = tokenstore.build(docs, PATH, "key", stride=16, per_shard=8)
    for other in ({"key": "other"}, {"stride": 8}, {"per_shard": 16}):
        with pytest.raises(ValueError, match="another order"):
            tokenstore.build(docs, PATH, **({"key": "key", "stride": 16, "per_shard": 8} | other), path=store.path, resume=True)
    with pytest.raises(ValueError, match="another order"):
        tokenstore.build(docs.where("doc_id > 0"), PATH, "key", stride=16, per_shard=8, path=store.path, resume=True)
    assert len(store.read(spark).collect()) == store.n


def test_numbers_that_are_not_digits(spark):
    words = ["x²", "²", "½.", "aⅧ,", "১২", "e٤"]
    made = WordIds(PATH)
    for text, ids in zip(words, made.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_filtered_table_is_numbered_in_its_order(spark):
    """As many runs of neighbouring rows as rows: they are summed within their file."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0")
    index = tokenstore.build(docs, PATH, key="k", stride=512).index.orderBy("number").collect()
    assert [r["number"] for r in index] == list(range(len(index))) == sorted(r["slot"] for r in index)
    expected = [r["doc_id"] for r in docs.select("doc_id").collect()]  # one file, in its order
    assert list(dict.fromkeys(r["doc_id"] for r in index)) == expected
