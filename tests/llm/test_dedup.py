"""SimHash, decontamination, surrogates, sharding, media and the pipeline, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from skein.llm import components, decontaminate, media, pii, sharding, simhash

TEXTS = ["the quick brown fox jumps over the lazy dog again and again", "The QUICK brown fox jumps over the lazy dog again and again", None, "", "  \t\n", "one", "one two", "one two three", "Éa Éb Éc", "same same same same", "x " * 30_000, "a\x0bb\x0cc d\x85e f g"]


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(fps))]
    return [min(ids[j] for j in range(len(fps)) if roots[j] == r) for r in roots]


def test_near_duplicates(spark):
    rows = [(i + 5, t, "fp", i) for i, t in enumerate(TEXTS)] + [(99, TEXTS[0], "fp", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    assert [found[i]["fp"] & (1 << 64) - 1 for i in ids] == fps
    assert [found[i]["component_id"] for i in ids] == brute_components(fps, ids)
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("parts", [1, 2])
def test_no_link_is_lost(spark, parts):
    r = random.Random(parts)
    fps = set()
    for _ in range(25):
        center = r.getrandbits(64)
        for _ in range(12):
            x = center
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, dtype=np.uint64).view(np.int64)}))
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(frame, 3, parts)).collect()}
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    got: dict = {}
    for i, x in enumerate(signed):
        got.setdefault(roots.get(x, x), []).append(i)
    assert sorted(map(min, got.values())) == sorted(set(brute_components(fps, list(range(len(fps))))))


def test_golay_is_perfect():
    code = simhash.Golay(3)
    y = np.random.default_rng(1).integers(0, 1 << 23, 500)
    home, _ = code.homes(y)
    assert (np.bitwise_count(home ^ y) <= 3).all() and np.isin(home, code.codes).all()
    row, anchor, beyond = code.visits(y[:20])
    for i in range(20):
        d = np.bitwise_count(code.codes ^ y[i])
        assert sorted(anchor[row == i].tolist()) == sorted((code.codes[d <= 6] >> 11).tolist())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_matching(spark):
    r = random.Random(4)
    items, docs = [], []
    for i in range(12):
        words = ["".join(r.choice("abcd") for _ in range(r.randint(2, 6))) for _ in range(12)]
        items.append((i, " ".join(words)))
        changed = list(" ".join(words))
        for _ in range(r.randint(0, 9)):
            changed[r.randrange(len(changed))] = r.choice("abcd x")
        docs.append((i, "Zzz. " + "".join(changed).upper() + " yyy", "k"))
    items += [(50, None), (51, "..."), (52, items[0][1])]
    docs += [(90, None, "k"), (91, "", "k"), (92, docs[0][1], "k"), (None, docs[1][1], "k")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, holds_item string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(m["doc_id"], m["item_id"]): m for m in decontaminate.matches(d, b, rate=0.12).collect()}
    expected = {}
    for i, t, _ in docs:
        for k, item in items:
            p = decontaminate.normalized(item)
            if p.strip() and t:
                e = distance(p, decontaminate.normalized(t))
                if e <= decontaminate.budget(len(p), 0.12):
                    expected[i, k] = e
    assert {k: m["distance"] for k, m in found.items()} == expected and (0, 52) in expected
    for (i, k), m in found.items():
        text = next(t for j, t, _ in docs if j == i)[m["start"] : m["stop"]]
        assert distance(decontaminate.normalized(text), decontaminate.normalized(dict(items)[k])) <= 2 * m["distance"] + 2
    kept = decontaminate.clean(d, b, rate=0.12).collect()
    assert sorted(str(x["doc_id"]) for x in kept) == sorted(str(i) for i, *_ in docs if not any(j == i for j, _ in expected))
    assert kept[0].asDict().keys() == {"doc_id", "text", "holds_item"}
    assert decontaminate.matches(d, b.where("item_id < 0")).count() == 0


PII = [
    "Write to Bob.Smith@Mail7.example.com or bob.smith@mail7.example.com, call +1 (017) 555-7713 or +1 017 555 7713.",
    "ip 97.51.17.173. card 4111 1111 1111 1111 and 4111-1111-1111-1111, 9807915762804490 7536784127813050 end",
    'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" ok',
    "Herr Müller met Frau Anna Schmidt and Г-н Иванов; Dr. Lee",
    "IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789",
    "nothing here", None, "", "4111111111111111", "2 Mrs. cats v1.2.3 on 2020-01-02 and 10.000",
    "again 97.51.17.173 and Frau Anna Schmidt", "again 97.51.17.173 and Frau Anna Schmidt",
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t, i, "n") for i, t in enumerate(PII)] + [(None, "x@y.example", 0, "n")], "doc_id bigint, text string, rid int, n_entities string")
    found = pii.surrogates(docs, "key")
    assert found.columns[:4] == docs.columns
    rows = {r["doc_id"]: r for r in found.collect()}
    out = {i: r["text"] for i, r in rows.items()}
    for i in (5, 6, 7, 9):
        assert out[i] == PII[i]
    everything = " ".join(t for t in out.values() if t)
    for secret in ("97.51.17.173", "4111", "9807915762804490", "9b0b3c6a43eb", "Müller", "Schmidt", "Иванов", "3704 0044", "123-45-6789", "555-7713", "Smith", "mail7", "x@y"):
        assert secret not in everything
    assert out[10] == out[11] and out[10].split()[1] in out[1]
    person = re.search("Frau (\\S+ \\S+)", out[3])[1]
    assert person in out[10] and person.split()[0] in pii.GIVEN["Latin", "f"].split()
    assert re.search(r"Г-н [А-Я][а-я]+;", out[3]) and "Dr. " in out[3]
    a, b = re.search(r"card ([\d ]{19}) and ([\d-]{19}),", out[1]).groups()
    assert a.replace(" ", "") == b.replace("-", "") == out[8] and luhn(out[8]) and out[8][0] == "4"
    assert re.search(r'token = "[0-9a-f]{40}" ok', out[2])
    p, q = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\.", out[0]).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q)
    x, y = re.search(r"to (\S+) or (\S+),", out[0]).groups()
    assert x.lower() == y.lower()
    again = {r["doc_id"]: r["text"] for r in pii.surrogates(docs.repartition(5), "key").collect()}
    assert again == out
    assert {r["doc_id"]: r["text"] for r in pii.surrogates(docs, "other").collect()} != out
    assert pii.surrogates(docs.where("rid < 0"), "key").count() == 0


def test_capital_secrets(spark):
    secrets = ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "quietkeyword", "hush-hush-word", "ABCDEFABCDEFABCDEFABCDEFABCDEFAB"]
    texts = [f'TOKEN = "{secrets[0]}"', f'API_KEY="{secrets[1]}"', f'Password: "{secrets[2]}"', f"bare {secrets[3]} and {secrets[0]} 1"]
    out = {r["doc_id"]: r["text"] for r in pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "key").collect()}
    assert not [s for s in secrets[:3] for i in range(3) if s in out[i]] and secrets[0] not in out[3] and secrets[3] not in out[3]
    new = out[0].split('"')[1]
    assert out[0].startswith('TOKEN = "') and set(new) <= set("0123456789ABCDEF") and len(new) == 40 and new in out[3]


def test_keys_without_digits(spark):
    secrets = ["AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "abcdef" * 6, "ABCDEF" * 6]
    docs = spark.createDataFrame([(i, f"see {s} here") for i, s in enumerate(secrets)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.surrogates(docs, "key").collect()}
    assert not [s for i, s in enumerate(secrets) if s in out[i]]


def test_clashing_draws_are_redrawn(spark):
    """Two-digit forms leave little room: replacements must still be distinct and new."""
    forms = spark.createDataFrame([("card", f"{i:02d}") for i in range(30)], "kind string, form string")
    solved = {r["form"]: r["new"] for r in pii.resolve(forms, "k", 3).collect()}
    assert len(set(solved.values())) == 30 and not set(solved.values()) & set(solved)


def test_sharding(spark):
    rows = [(i, i % 50 + 1) for i in range(400)] + [(1000, 5000)] + [(2000, 30)] * 40 + [(None, 3), (3000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, n int")
    from pyspark.sql import functions as F

    found = sharding.assign(docs, "doc_id", F.col("n"), 300).collect()
    assert sorted(str(r["key"]) for r in found) == sorted(str(i) for i, _ in rows)
    shards: dict = {}
    for r in found:
        shards.setdefault((r["depth"], r["prefix"], r["page"]), []).append(r)
    for (depth, prefix, _), own in shards.items():
        assert sum(r["size"] for r in own) == own[0]["bytes"] and len(own) == own[0]["rows"]
        assert own[0]["bytes"] <= 300 or len(own) == 1
        for r in own:
            text = "null" if r["key"] is None else str(r["key"])
            assert int(hashlib.md5(text.encode()).hexdigest()[:15], 16) >> (60 - depth) == prefix
    assert sharding.assign(docs.where("doc_id < 0"), "doc_id", F.col("n"), 300).count() == 0


def test_media_round_trip(spark):
    texts = ["", None, "a" * 100_000, "long " * 9000 + "end", "long " * 9000 + "END", "é" * 700, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, media string")
    kept = media.store(docs, buckets=3, waves=2)
    read = {bytes(r["media_sha256"]): bytes(r["media"]) for r in kept.media().collect()}
    rows = kept.manifest.collect()
    assert len(rows) == len(texts)
    for r in rows:
        stored = read[bytes(r["media_sha256"])]
        samples = media.samples_of(stored)
        data = (texts[r["doc_id"]] or "").encode()
        assert samples == data + b"\xff" * (len(samples) - len(data)) and len(samples) % 576 == 0 and len(samples) - len(data) <= 576
        assert len(stored) == r["media_bytes"] and r["n_bytes"] == len(data)
    stored = spark.table(kept.chunks)
    assert stored.count() == stored.select("digest").distinct().count() == len({bytes(d) for r in rows for d in r["digests"]})
    found = {bytes(r["media_sha256"]): r for r in kept.features().collect()}
    assert all(r["tail_crc32"] == zlib.crc32(media.samples_of(read[s])[-32:]) for s, r in found.items())
    before = stored.count()
    media.store(docs, buckets=3, waves=2, known=kept.chunks)
    assert spark.table(kept.chunks).count() == before
    assert media.store(docs.where("doc_id < 0"), buckets=3).features().count() == 0


def test_cuts_follow_content():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(60_000))
    a, b = {d for d, _ in media.chunks(data)}, {d for d, _ in media.chunks(b"inserted" + data)}
    assert len(a & b) > 0.8 * len(a)
    sizes = [len(c) for _, c in media.chunks(data)]
    assert sum(sizes) == len(data) and max(sizes) <= media.LARGEST and min(sizes[:-1]) >= media.SMALLEST


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, twice, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < 0"), sf).count() == 0
        twice = spark.createDataFrame(out.collect(), out.schema)
    kept = {r["doc_id"] for r in twice.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == kept and len(kept) > 100
    text = " ".join(r["text"] for r in twice.collect())
    assert not any(decontaminate.normalized(b["text"]) in decontaminate.normalized(text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect())


def test_people_keep_their_names(spark):
    texts = ["Frau Anna Weber and Dr. Anna Weber met Frau Weber, FRAU X.", "Mr John Smith and Mr Smith and Mr John Weber; Mr ANNA", "Mr Kim Lee, Mrs Kim Lee", *[f"Mr Given{chr(97 + i % 26)}{chr(97 + i // 26)} Surname{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], *[f"a@host{i}.com" for i in range(300)], "b@host1.com a@HOST1.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.surrogates(docs, "key").collect()}
    first, second = re.match(r"Frau (\w+ \w+) and Dr\. (\w+ \w+) met Frau (\w+),", out[0]), re.match(r"Mr (\w+) (\w+) and Mr (\w+) and Mr (\w+) (\w+);", out[1])
    assert first[1] == first[2] and first[1].split()[1] == first[3] == second[5] and first[1].split()[0] in pii.GIVEN["Latin", "f"].lower().title().split()
    assert second[2] == second[3] and second[1] == second[4] and second[2] != second[5]
    people = {out[i] for i in range(3, 303)}
    assert len(people) == 300 and all(re.fullmatch(r"Mr [A-Z][a-z]+ [A-Z][a-z]+", p) for p in people)
    hosts = [out[i].split("@")[1] for i in range(303, 603)]
    assert len(set(hosts)) == 300 and all(h.endswith(".example") for h in hosts)
    assert out[603].split()[0].split("@")[1] == out[603].split()[1].split("@")[1].lower() == hosts[1]


def test_shards_are_written(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, i % 40 + 1, "s", "k") for i in range(200)] + [(None, 7, None, None)], "doc_id bigint, n int, shard string, shard_key string")
    placed = sharding.write_shards(docs, "doc_id", F.col("n"), 150, f"file://{tmp_path}/shards")
    read = spark.read.parquet(f"file://{tmp_path}/shards")
    assert read.count() == 201 and {"shard", "shard_key", "shard_"} <= set(read.columns)
    sums = {r["shard_"]: r["n"] for r in read.groupBy("shard_").agg(F.sum("n").alias("n")).collect()}
    assert max(sums.values()) <= 150 and len(sums) == placed.select("depth", "prefix", "page").distinct().count()
    with pytest.raises(ValueError, match="repeats"):
        sharding.write_shards(docs.union(docs.limit(1)), "doc_id", F.col("n"), 150, f"file://{tmp_path}/again")


def test_directories_of_any_size_give_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, i % 50 + 1) for i in range(300)], "doc_id bigint, n int")
    broadcast = {tuple(r) for r in sharding.assign(docs, "doc_id", F.col("n"), 200).collect()}
    monkeypatch.setattr(sharding, "BROADCAST_LEAVES", 0)
    assert {tuple(r) for r in sharding.assign(docs, "doc_id", F.col("n"), 200).collect()} == broadcast


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = spark.createDataFrame([(i, f"item number {i} has {i * 37} words and {i * 91} letters") for i in range(20)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"before item number {i} has {i * 37} words and {i * 91} letters after") for i in range(0, 20, 2)] + [(99, "clean")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items, rate=0.02).where("distance = 0").collect()} == {(i, i) for i in range(0, 20, 2)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items, rate=0.02).collect()] == [99]


def test_query_functions_on_odd_rows(spark, tmp_path):
    """The thin queries of op1, 2, 4, 5, 6, 9 and 10 over null, empty, long and repeated rows, and over empty tables."""
    from skein.llm import queries

    long = "word " * 30_000
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, long), (5, long), (5, long), (6, "ab " * 700 + "x@y.example 4111 1111 1111 1111"), (7, "the item that must not be in any text at all")]
    for name, docs in (("some", rows), ("none", [])):
        spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "item that must not be in any text"), (2, None)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    run = lambda name, folder="some": queries.QUERIES[name](spark, f"file://{tmp_path}/{folder}").collect()
    assert [(r["doc_id"], r["item_id"]) for r in run("op1_benchmark_decontamination")] == [(7, 1)]
    media_rows = {r["doc_id"]: r for r in run("op2_media_columns")}
    for i, text in rows:
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        r = media_rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and r["media_bytes"] == len(media.wav(payload))
    groups = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run("op4_simhash_near_dedup")}
    for i, text in rows:
        assert groups[i][0] == f"{plain_fingerprint(text):016x}"
    assert groups[0][1] == groups[1][1] == groups[2][1] == 0 and groups[5][1] == 4
    assert {r["doc_id"]: r["n_entities"] for r in run("op5_pii_surrogates")} == {**dict.fromkeys(range(8), 0), 6: 2}
    packed = run("op6_best_fit_packing")
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and {r["doc_id"] for r in packed} == set(range(8))
    assert sorted(r["doc_id"] for r in run("op9_sharding")) == sorted(i for i, _ in rows)
    ordered = run("op10_training_order")
    assert sorted(r["slot"] for r in ordered) == list(range(len(ordered)))
    for name in ("op1_benchmark_decontamination", "op2_media_columns", "op4_simhash_near_dedup", "op5_pii_surrogates", "op6_best_fit_packing", "op9_sharding", "op10_training_order"):
        assert run(name, "none") == []
