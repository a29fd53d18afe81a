"""Token counts, fill-in-the-middle and ordered funnels, against plain versions."""

import hashlib
import heapq
import random
import re
from datetime import datetime, timedelta

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import funnels, infill, queries, tokencount
from skein.llm.funnels import MINUTE, Funnel

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world! it's DON'T ÀÉ", None, "", " \n\t", "<|endoftext|> foo<|endoftext|>bar", "İstanbul ΣΑΣ ² ½x a\x1cb c\x85d", "日本語 テキスト한국어",
    "a" * 3_000, "one two three " * 900, "same text", "same text", "x́y é é", "foo_bar __ 'sx x's a…b “q” 12,34", "😀🤦🏼‍♂️ x", "a <P> b", "b <S", "c<M><M>", "é < b\u0085 c\x0b\x0c d",
    " lead and trail \r\n", "x\x00y z", "word " * 60_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, i, "y") for i, t in enumerate(TEXTS)] + [(9, "same text", 9, 9, "y"), (None, "no id here", 0, 0, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, length int, Form string").repartition(3)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_equal_the_library(docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = tokencount.token_counts(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id here" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_token_counts_of_random_texts_and_few_kept_words():
    tokenizer, counter, rng = Tokenizer.from_file(PATH), tokencount.TokenCounts(PATH, most_words=5), random.Random(7)
    parts = ["The", "quick", "'s", "'LL", "é", "ß", "Σ", "1", "½", ".", "--", " ", "\n", "　", "日", "🤦🏼", "<|endoftext|>", "x" * 30, "́", "\x1c", "Ünïcode", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)]
    assert counter.count(texts).tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_merging_pops_the_lowest_rank_then_the_leftmost():
    def plain(symbols, merger):
        symbols, n = list(symbols), 0
        while True:
            ranked = [(merger.ranks.get(a << merger.width | b), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
            ranked = [x for x in ranked if x[0] is not None]
            if not ranked:
                return n
            rank, i = heapq.nsmallest(1, ranked)[0]
            symbols[i : i + 2] = [merger.made[rank]]
            n += 1

    merger, rng = tokencount.TokenCounts(PATH).merger, random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abeinorst", k=rng.randrange(1, 40)))
        symbols = [*map(merger.first.__getitem__, word[:-1]), merger.last[word[-1]]]
        assert merger.count(word) == len(symbols) - plain(symbols, merger)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="white space|every byte|merging"):
        tokencount.TokenCounts(public_tokenizers.path("byte_bpe_50k.json"))


def arranged(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim else "spm" if h4 % 100 < spm else "psm"
    output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    return (doc_id, len(units), form, output, None if form == "plain" else len(prefix), None if form == "plain" else len(middle))


@pytest.mark.parametrize(("fim", "spm"), [(50, 80), (100, 0), (100, 100)])
def test_fill_in_the_middle(docs, fim, spm):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = infill.rearranged(docs, seed=42, fim_percent=fim, spm_percent=spm)
    rows = sorted(map(tuple, made.collect()), key=str)
    assert rows == sorted((arranged(r["doc_id"], r["text"], 42, fim, spm) for r in docs.collect()), key=str)
    for r in infill.restored(made).collect():
        assert r["text"] == (texts[r["doc_id"]] or "")
    for r in infill.digests(docs, seed=42, fim_percent=fim, spm_percent=spm).collect():
        assert r["output_sha256"] == digest(arranged(r["doc_id"], texts[r["doc_id"]], 42, fim, spm)[3])
        assert r["restored_sha256"] == digest(texts[r["doc_id"]] or "")


def test_digests_come_from_the_output_alone(spark):
    outputs = spark.createDataFrame([(1, "psm", "<P>a <S<S> c<M<M> b"), (2, "spm", "<S> c<<P>a<M> b"), (3, "plain", "t")], "doc_id bigint, form string, output string")
    assert {r["doc_id"]: r["text"] for r in infill.restored(outputs).collect()} == {1: "a <S b c<M", 2: "a b c<", 3: "t"}


def plain_funnels(rows, wanted, window):
    """(funnel, client) to the waits of each step, straight from the definition."""
    by: dict = {}
    for client, kind, at in {r for r in rows if None not in r}:
        by.setdefault(client, []).append((at, kind))
    out: dict = {}
    for client, events in by.items():
        events.sort()
        for f in wanted:
            for start in (t for t, k in events if k == f.steps[0]):
                waits, last = out.setdefault((f.name, client), [[] for _ in f.steps]), start
                waits[0].append(0)
                for i, step in enumerate(f.steps[1:], start=1):
                    there = next((t for t, k in events if k == step and t > last), None)
                    if there is None or there - start > window or any(last < t <= there and k in f.excluding for t, k in events):
                        break
                    waits[i].append(there - last)
                    last = there
    return out


def expected_rows(rows, wanted, window, percent=25):
    out, depth = [], max(len(f.steps) for f in wanted)
    for (name, client), waits in plain_funnels(rows, wanted, window).items():
        waits += [[]] * (depth - len(waits))
        n = [len(w) for w in waits]
        t = [sorted(w)[-(-percent * len(w) // 100) - 1] if w else None for w in waits[1:]]
        out.append([name, client, *n, sum(1 for x in n if x), *t])
    return sorted(([*r, sum(1 for x in out if (x[0], x[2 + depth]) == (r[0], r[2 + depth]))] for r in out), key=str)


WANTED = [*queries.FUNNELS]
EPOCH = datetime(1970, 1, 1)


def events(spark, rows):
    found = [(c, k, None if at is None else EPOCH + timedelta(microseconds=at), "x", 1) for c, k, at in rows]
    return spark.createDataFrame(found, "client_id bigint, kind string, arrived_at timestamp_ntz, client string, piece int").repartition(3)


def compared(spark, rows, wanted=WANTED, window=5 * MINUTE, **options):
    frame = funnels.funnel_counts(events(spark, rows), wanted, window, **options)
    depth = max(len(f.steps) for f in wanted)
    columns = ["funnel", "client", *(f"n{k}" for k in range(1, depth + 1)), "deepest", *(f"t{k}" for k in range(2, depth + 1)), "same_depth"]
    assert sorted(map(list, frame.select(columns).collect()), key=str) == expected_rows(rows, wanted, window)


def test_funnels_of_random_events(spark):
    rng, rows = random.Random(11), []
    for client in (1, 2, 3, -4):
        at = rng.randrange(10**15) if client > 0 else -(10**12)
        for _ in range(400 if client == 1 else 60):
            at += rng.choice([0, 0, 1, 7_000_000, 40_000_000, 100_000_000, 5 * MINUTE, 5 * MINUTE + 1, 20 * MINUTE])
            rows.append((client, rng.choice(["view", "view", "click", "click", "purchase", "signup", "error", "other", None]), at))
    rows += rows[:50] + [(None, "view", 5), (1, "view", None)]
    compared(spark, rows)
    compared(spark, rows, slice=5 * MINUTE)


def test_funnels_at_the_edges(spark):
    m = MINUTE
    chains = [
        [("view", 0), ("click", m), ("view", 2 * m), ("purchase", 5 * m)],  # all steps, the last just in time
        [("view", 0), ("click", m), ("view", 2 * m), ("purchase", 5 * m + 1)],  # too late
        [("view", 0), ("click", m), ("error", m), ("view", 2 * m)],  # an error at the time of step 2 blocks it
        [("view", 0), ("error", 0), ("click", m), ("view", 2 * m)],  # at the time of step 1 it doesn't
        [("view", 0), ("click", 0), ("click", m), ("purchase", m), ("view", m)],  # several kinds of one time
        [("click", 15 * m - 1), ("click", 15 * m), ("purchase", 20 * m - 1)],  # over the end of a slice
        [("click", 15 * m - 1), ("signup", 15 * m), ("click", 15 * m), ("purchase", 16 * m)],
    ]
    compared(spark, [(c, k, at) for c, chain in enumerate(chains) for k, at in chain])


def test_funnels_with_an_excluded_step_one_step_and_no_events(spark):
    rows = [(1, k, i * 1_000_000) for i, k in enumerate(["a", "b", "a", "c", "b", "a", "b"])]
    compared(spark, rows, [Funnel("never", ("a", "b"), ("b",)), Funnel("one", ("a",)), Funnel("two", ("b", "c", "a"))], window=3_000_000)
    assert funnels.funnel_counts(events(spark, []), WANTED).count() == 0


def test_funnels_do_not_depend_on_the_zone(spark):
    rows = [(1, k, 1_711_846_500_000_000 + i * MINUTE * 2) for i, k in enumerate(["view", "click", "view", "purchase"] * 20)]  # a night in which clocks change
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        compared(spark, rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokencount.token_counts(none, PATH).count() == infill.rearranged(none).count() == infill.digests(none).count() == 0
