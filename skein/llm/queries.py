"""The operators' queries over the driver's tables; thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, funnels, infill, langid, media, packing, pii, quality, sharding, simhash, tokencount, tokenstore, toxicity
from skein.llm.common import materialize, remainder

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _labels(spark: SparkSession, sf_dir: str, divisor: int, kept_out: int) -> DataFrame:
    """The labels that may be learned from: those whose id hash has another remainder."""
    return _table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), divisor) != kept_out)


def written(df: DataFrame, name: str) -> DataFrame:
    """A stage's rows, stored in the shared folder and read again."""
    return materialize(df, name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.08)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.store(_table(spark, sf_dir, "documents"))
    rows = kept.manifest.select("doc_id", "n_bytes", "media_sha256", F.size("digests").alias("n_chunks"))
    found = rows.join(kept.features(), "media_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature", "n_chunks")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir, 4, 2)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, seed=42, threshold=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


PII_KEY = "skein-surrogates"


def pii_key(spark: SparkSession) -> str:
    """The key of the surrogates: the session's ``spark.skein.surrogates.key``; without one a known key, good for tests only."""
    return spark.conf.get("spark.skein.surrogates.key", None) or spark.sparkContext.getConf().get("spark.skein.surrogates.key") or PII_KEY


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(_table(spark, sf_dir, "documents"))


def packed_rows(docs: DataFrame) -> DataFrame:
    packed = packing.pack(docs, _vocabulary(), capacity=4096, end_id=1)
    return packed.placement.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("bigint").alias("offset"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, docs.where(remainder(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir, 5, 0)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


SHARD_BYTES = 1 << 20


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)
    return found.select(F.col("key").alias("doc_id"), F.col("size").alias("n_bytes"), F.col("depth").cast("bigint").alias("depth"), "prefix", F.col("bytes").cast("bigint").alias("shard_bytes"), F.col("rows").cast("bigint").alias("shard_docs"))


ORACLES["op9_sharding"] = f"""
WITH hashed AS (
    SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents
), split AS (
    SELECT doc_id, n_bytes, d AS depth, h >> (60 - d)::INTEGER AS prefix FROM hashed, range(0, 61) AS t(d)
), buckets AS (
    SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM split GROUP BY depth, prefix
), fitting AS (
    SELECT s.doc_id, min(s.depth) AS depth FROM split s JOIN buckets b USING (depth, prefix)
    WHERE b.shard_bytes <= {SHARD_BYTES} OR b.shard_docs = 1 GROUP BY s.doc_id
)
SELECT s.doc_id, s.n_bytes, s.depth, s.prefix, CAST(b.shard_bytes AS BIGINT) AS shard_bytes, b.shard_docs
FROM fitting f JOIN split s USING (doc_id, depth) JOIN buckets b USING (depth, prefix)
"""


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.build(_table(spark, sf_dir, "documents"), _vocabulary(), key="skein-epoch-0", stride=512)
    if not store.n:
        return store.index.withColumns({"shard": F.col("slot"), "byte_offset": F.col("slot"), "ids_crc32": F.col("slot")})
    found = store.index.join(store.checksums(spark), "slot")
    place = {"shard": F.floor(F.col("slot") / store.per_shard), "byte_offset": F.col("slot") % store.per_shard * store.record}
    return found.withColumns(place).select("doc_id", "piece", "n_ids", "number", "slot", "shard", "byte_offset", "ids_crc32")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), _vocabulary(), limit=2048)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80)


ORACLES["op12_fill_in_middle"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), drawn AS (
    SELECT *, len(units) AS n, [('0x' || h[1:8])::BIGINT % (len(units) + 1), ('0x' || h[9:16])::BIGINT % (len(units) + 1)] AS ends,
           regexp_matches(text, '<[PSM]>') OR text = '' OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm FROM cut
), placed AS (
    SELECT *, list_aggregate(units[:list_min(ends)], 'string_agg', '') AS p, list_aggregate(units[list_min(ends) + 1:list_max(ends)], 'string_agg', '') AS m,
           list_aggregate(units[list_max(ends) + 1:], 'string_agg', '') AS s FROM drawn
), parted AS (SELECT * EXCLUDE (p, m, s), coalesce(p, '') AS p, coalesce(m, '') AS m, coalesce(s, '') AS s FROM placed)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', s, '<M>', m) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""


FUNNELS = (
    funnels.Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    funnels.Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    funnels.Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def op13_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = funnels.funnel_counts(_table(spark, sf_dir, "clicks"), FUNNELS, window=5 * funnels.MINUTE, percent=25)
    return found.select("funnel", F.col("client").alias("client_id"), "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth")


def _funnel_sql() -> str:
    """Every event time knows the next later time of each kind; attempts follow these links step by step."""
    kinds = sorted({k for f in FUNNELS for k in (*f.steps, *f.excluding)})
    nexts = ", ".join(f"min(t) FILTER ({k}) OVER w AS next_{k}" for k in kinds)
    has = ", ".join(f"bool_or(kind = '{k}') AS {k}" for k in kinds)

    def steps(f: funnels.Funnel) -> str:
        joins, reached = "", []
        for k, (step, out) in enumerate(zip(f.steps[1:], [f.excluding[0]] * 3, strict=True), start=2):
            allowed = f"e{k - 1}.next_{step} <= e1.t + INTERVAL 5 MINUTE AND (e{k - 1}.next_{out} IS NULL OR e{k - 1}.next_{out} > e{k - 1}.next_{step})"
            joins += f" LEFT JOIN linked e{k} ON e{k}.client_id = e1.client_id AND e{k}.t = e{k - 1}.next_{step} AND {allowed}"
            reached.append(f"epoch_us(e{k}.t) - epoch_us(e{k - 1}.t) AS d{k}")
        return f"SELECT '{f.name}' AS funnel, e1.client_id, {', '.join(reached)} FROM linked e1{joins} WHERE e1.{f.steps[0]}"

    waits = ", ".join(f"list_sort(list(d{k}) FILTER (d{k} IS NOT NULL))[((25 * count(d{k}) + 99) // 100)::BIGINT] AS t{k}" for k in (2, 3, 4))
    return f"""
WITH places AS (
    SELECT client_id, arrived_at AS t, {has} FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL GROUP BY ALL
), linked AS (
    SELECT *, {nexts} FROM places WINDOW w AS (PARTITION BY client_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), attempts AS ({' UNION ALL '.join(map(steps, FUNNELS))}), counted AS (
    SELECT funnel, client_id, count(*) AS n1, count(d2) AS n2, count(d3) AS n3, count(d4) AS n4,
           CASE WHEN count(d4) > 0 THEN 4 WHEN count(d3) > 0 THEN 3 WHEN count(d2) > 0 THEN 2 ELSE 1 END AS deepest, {waits}
    FROM attempts GROUP BY funnel, client_id
)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM counted
"""


ORACLES["op13_ordered_funnels"] = _funnel_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_media_columns": op2_media_columns,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_training_order": op10_training_order,
    "op11_token_counts": op11_token_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ordered_funnels": op13_ordered_funnels,
}
