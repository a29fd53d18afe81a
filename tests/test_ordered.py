"""Running values, debouncing and searches that hold for one key with all rows, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import changes, ordered, search
from skein.plans import search as plans


@pytest.fixture(scope="module", autouse=True)
def several_partitions(spark):
    """Few rows are not merged into one partition here."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]) if i > 40 else "hot", i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, v int"), sorted(rows)


def test_running_values_cross_partitions(spark, numbers):
    frame, rows = numbers
    placed = ordered.placed(frame, ["k", "at"])
    assert placed.select("part_").distinct().count() > 1
    out = ordered.position(placed, "pos")
    out = ordered.before(out, F.struct("k", "v"), "prev")
    out = ordered.latest(out, F.col("v"), "last")
    out = ordered.following(out, F.col("v"), "next")
    out = ordered.running_sum(out, F.coalesce("v", F.lit(0)), "total", "k")
    last, totals = None, {}
    nexts, following = [], None
    for _, _, v in reversed(rows):
        following = v if v is not None else following
        nexts.append(following)
    nexts.reverse()
    found = out.orderBy("pos").collect()
    assert len(found) == len(rows)
    for i, (r, (k, at, v)) in enumerate(zip(found, rows, strict=True)):
        last = v if v is not None else last
        totals[k] = totals.get(k, 0) + (v or 0)
        before = None if not i else (rows[i - 1][0], rows[i - 1][2])
        assert (r["pos"], r["k"], r["at"]) == (i, k, at)
        assert (None if r["prev"] is None else tuple(r["prev"])) == before
        assert (r["last"], r["next"], r["total"]) == (last, nexts[i], totals[k])


def test_doubled_links_reach_what_a_walk_reaches(spark):
    rng = random.Random(2)
    links = {i: rng.randrange(i + 1, min(i + 9, 300)) for i in range(299)}
    starts, wanted = [0, 7, 150], set()
    for at in starts:
        while at is not None and at not in wanted:
            wanted.add(at)
            at = links.get(at)
    found = ordered.reached(spark.createDataFrame([(s,) for s in starts], "at bigint"), spark.createDataFrame(list(links.items()), "at bigint, to bigint"))
    assert sorted(r["at"] for r in found.collect()) == sorted(wanted)


def walked(rows, gap, wait):
    """Batch numbers of (key, seconds, id), one event after another."""
    out, state = {}, {}
    for key, t, event in sorted(rows):
        opened, last, batch = state.get(key, (None, None, 0))
        if opened is None or t >= min(last + gap, opened + wait):
            opened, batch = t, batch + 1
        state[key] = (opened, t, batch)
        out[event] = batch
    return out


@pytest.mark.parametrize(("gap", "wait"), [(5, 30), (30, 5), (7, 7)])
def test_capped_batches_of_one_busy_key(spark, gap, wait):
    rng, t, rows = random.Random(gap), 0, []
    for i in range(500):
        t += rng.choice([0, 0, 1, 1, 2, 4, 5, 6, 29, 30, 31]) if i % 50 else 200
        rows.append(("all", t, i))
    rows += [("other", 3, 1000), ("other", 4, 1001)]
    start = datetime(2024, 1, 1)
    frame = spark.createDataFrame([(k, start + timedelta(seconds=s), e, "p") for k, s, e in rows], "key string, ts timestamp, event_id long, path string").repartition(4)
    assert {r["event_id"]: r["batch"] for r in changes.capped(frame, gap, wait).collect()} == walked(rows, gap, wait)
    quiet = walked(rows, gap, float("inf"))
    found = changes.sessions(frame, gap).collect()
    assert sum(r["event_count"] for r in found) == len(rows) and len(found) == len({(k, quiet[e]) for k, _, e in rows})


def test_adjacent_repeats_of_many_hits(spark):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(5)}", "semantic", 0, "p", rng.choice([None, 1, 2]), float(rng.randrange(20))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "id string, layer string, index_order int, path string, line_start int, rank_score double")
    assert sorted(map(str, search.drop_adjacent_of_many(frame).collect())) == sorted(map(str, search.drop_adjacent(frame).collect()))


def test_an_index_follows_its_tables(spark, tmp_path):
    docs = lambda n: spark.createDataFrame([(i, f"word{i} common", "en", "src0", 5) for i in range(n)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, "item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n in (9, 4, 6):
        docs(n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert search.bm25(plans.stored(spark, str(tmp_path)), "common").count() == n
    before = plans.stored(spark, str(tmp_path))
    assert plans.stored(spark, str(tmp_path)) is before


def test_grams_find_what_a_scan_finds(spark):
    fields = "bundle_id string, concept_id string, type string, title string, description string, tags array<string>, headings array<string>, extensions array<string>, citations array<string>, body string"
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcé", k=rng.randrange(1, 6)))
    rows = [("b", f"c/{i}{word()}", word(), rng.choice([None, word()]), None, [word(), word()], None, [], [word()], " ".join(word() for _ in range(6)).upper() if i % 3 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, fields).cache()
    grams = search.grams_of(docs).cache()
    for q in ("abc", "abca bcab", "éab", "ab", "c/1", "--a", "aaaa", "abc x"):
        scan, found = (sorted(map(str, search.weighted_search(docs, q, 100, grams=g).collect())) for g in (None, grams))
        assert found == scan
