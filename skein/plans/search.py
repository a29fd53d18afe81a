"""Search queries over ``documents`` (the semantic layer), ``benchmark`` (the syntax layer) and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.text import code_terms, slug, wiki_terms
from skein.operators import search as S
from skein.operators.storage import files_digest, new_path
from skein.plans.registry import query, table

TERMS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda t: lower(t))"


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and benchmark as one searchable table of two layers."""
    a = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.lit("semantic").alias("layer"), F.lit(0).alias("index_order"), "text", F.col("lang").alias("label"), F.concat_ws(".", "lang", "source").alias("qualified_name"), F.col("source").alias("path"), F.when(F.col("doc_id") % 3 == 0, "Function").when(F.col("doc_id") % 3 == 1, "File").otherwise("Symbol").alias("node_type"), (F.col("doc_id") % 7).alias("line_start"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("id"), F.lit("syntax").alias("layer"), F.lit(1).alias("index_order"), "text", F.lit("item").alias("label"), F.lit("item").alias("qualified_name"), F.lit("bench").alias("path"), F.lit("SyntaxCapture").alias("node_type"), F.lit(None).cast("bigint").alias("line_start"))
    return a.unionByName(b)


_STORED: dict[str, tuple[str, S.Index]] = {}


def stored(spark: SparkSession, sf_dir: str) -> S.Index:
    """The index of ``layered``: built and stored by the first search that meets these files, read until they change."""
    files = files_digest(*(table(spark, sf_dir, name) for name in ("documents", "benchmark")))
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if _STORED.get(key, ("",))[0] != files:
        _STORED[key] = files, S.store_index(layered(spark, sf_dir), new_path(spark, "index"))
    return _STORED[key][1]


LAYERED = f"""
docs AS (
  SELECT 'doc:' || doc_id AS id, 'semantic' AS layer, 0 AS index_order, {TERMS} AS terms, lang AS label, lang || '.' || source AS qualified_name, source AS path,
    CASE doc_id % 3 WHEN 0 THEN 'Function' WHEN 1 THEN 'File' ELSE 'Symbol' END AS node_type, doc_id % 7 AS line_start FROM documents
  UNION ALL
  SELECT 'item:' || item_id, 'syntax', 1, {TERMS}, 'item', 'item', 'bench', 'SyntaxCapture', NULL FROM benchmark
)"""


def scored_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return LAYERED + f""",
occ AS (SELECT id, unnest(terms) AS term FROM docs),
postings AS (SELECT id, term, count(*) AS tf FROM occ GROUP BY id, term),
lexicon AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (SELECT count(*) AS n, sum(len(terms)) AS tokens FROM docs),
scored AS (
  SELECT d.id, d.layer, d.index_order, round(sum(ln(1.0 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE)
    / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(d.terms) / (tokens / n))))) * 1e6) / 1e6 AS score
  FROM postings p JOIN lexicon USING (term) JOIN docs d ON d.id = p.id CROSS JOIN totals
  WHERE term IN ({listed}) GROUP BY d.id, d.layer, d.index_order
)"""


@query("tokenize_terms", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY doc_id, term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(code_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("wiki_tokenize", r"SELECT doc_id, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))), 'string_agg', ' ') AS terms FROM documents")
def wiki_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.array_join(F.array_sort(wiki_terms(F.col("text"))), " "), F.lit("")).alias("terms"))


@query("postings_tf", f"WITH {LAYERED} SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY id, term")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_index(layered(spark, sf_dir)).postings.select("id", "term", "tf")


@query("lexicon_df", f"WITH {LAYERED} SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY term")
def lexicon_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_index(layered(spark, sf_dir)).lexicon


@query("index_totals", f"WITH {LAYERED} SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS tokens FROM docs")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_index(layered(spark, sf_dir)).totals


DAMAGED = f"""WITH {LAYERED}, p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY id, term), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT 'lexicon' AS part, term AS key FROM d WHERE length(term) = 2 UNION ALL SELECT 'length', id FROM docs WHERE id LIKE 'doc:%7' AND len(terms) > 0 UNION ALL SELECT 'totals', count(*)::VARCHAR FROM docs"""


@query("index_invariants", DAMAGED)
def index_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that was damaged: each part's wrong rows are found, and no others."""
    whole = S.kept_index(layered(spark, sf_dir))
    lexicon = whole.lexicon.withColumn("df", F.col("df") + F.when(F.length("term") == 2, 1).otherwise(0))
    lengths = whole.lengths.withColumn("length", F.when(F.col("id").like("doc:%7") & (F.col("length") > 0), F.col("length") + 1).otherwise(F.col("length")))
    totals = whole.totals.withColumn("tokens", F.col("tokens") + 1)
    return S.Index(whole.postings, lexicon, lengths, totals).problems()


@query("bm25_topk", f"WITH {scored_sql(['thereand', 'the', 'nation'])} SELECT id, score FROM scored WHERE layer = 'semantic' ORDER BY score DESC, index_order, id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.bm25(stored(spark, sf_dir), "thereand The NATION")
    return S.top(scored.where("layer = 'semantic'"), 50).select("id", "score")


@query("search_multi_term", f"WITH {scored_sql(['and', 'de', 'la', 'ou', 'die'])} SELECT id, layer, index_order, score FROM scored")
def search_multi_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(stored(spark, sf_dir), "and de la ou die die")


RANKED = f"""{scored_sql(['en', 'that', 'with'])},
cand AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY score DESC, index_order, id) AS place FROM scored),
ranked AS (
  SELECT c.id, c.layer, c.index_order, c.score, d.path, d.line_start, d.node_type, round((0.25::DOUBLE * c.score / max(c.score) OVER (PARTITION BY c.layer)
    + 0.25::DOUBLE * CASE WHEN label = 'en that with' OR qualified_name = 'en that with' THEN 1.0::DOUBLE WHEN contains(label, 'en that with') THEN 0.8::DOUBLE WHEN contains(path, 'en that with') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
    + 0.5::DOUBLE * CASE node_type WHEN 'Function' THEN 1.0::DOUBLE WHEN 'File' THEN 0.8::DOUBLE WHEN 'Symbol' THEN 0.25::DOUBLE WHEN 'SyntaxCapture' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END) * 1e6) / 1e6 AS rank_score
  FROM cand c JOIN docs d USING (id) WHERE place <= 20
)"""


@query("rank_blend", f"WITH {RANKED} SELECT id, layer, score, rank_score FROM ranked")
def rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = layered(spark, sf_dir)
    best = S.bm25(stored(spark, sf_dir), "en that with")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("score"), "index_order", "id"))).where("place <= 20")
    return S.rank(docs.drop("layer", "index_order", "text").join(best, "id"), "en that with").select("id", "layer", "score", "rank_score")


@query("layer_hybrid_merge", f"WITH {RANKED}, o AS (SELECT *, row_number() OVER (ORDER BY CASE layer WHEN 'semantic' THEN 0 ELSE 1 END, rank_score DESC, index_order, path, line_start NULLS FIRST, id) AS position FROM ranked) SELECT id, layer, rank_score, CAST(position AS INTEGER) AS position FROM o WHERE position <= 30")
def layer_hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = layered(spark, sf_dir)
    best = S.bm25(stored(spark, sf_dir), "en that with")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("score"), "index_order", "id"))).where("place <= 20")
    ranked = S.drop_adjacent(S.rank(docs.drop("layer", "index_order", "text").join(best, "id"), "en that with"))
    return S.merge_layers(ranked, "hybrid", 30).select("id", "layer", "rank_score", "position")


@query("search_pipeline", f"WITH {RANKED.replace('place <= 20', 'place <= 25')} SELECT id, layer, rank_score, CAST(row_number() OVER (ORDER BY rank_score DESC, index_order, path, line_start NULLS FIRST, id) AS INTEGER) AS position FROM ranked WHERE layer = 'semantic' ORDER BY position LIMIT 25")
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = layered(spark, sf_dir)
    return S.search(stored(spark, sf_dir), docs.drop("layer", "index_order", "text"), "en that with", layer="semantic", limit=25).select("id", "layer", "rank_score", "position")


@query("dedup_adjacent", "WITH h AS (SELECT 'doc:' || (doc_id // 3) AS id, 'semantic' AS layer, 0 AS index_order, source AS path, doc_id % 7 AS line_start, round(n_chars / 500.0::DOUBLE) AS rank_score FROM documents), w AS (SELECT *, lag(id) OVER (PARTITION BY layer ORDER BY rank_score DESC, index_order, path, line_start NULLS FIRST, id) AS prev FROM h) SELECT id, path, line_start, rank_score FROM w WHERE prev IS NULL OR prev <> id")
def dedup_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.floor(F.col("doc_id") / 3)).alias("id"), F.lit("semantic").alias("layer"), F.lit(0).alias("index_order"), F.col("source").alias("path"), (F.col("doc_id") % 7).alias("line_start"), F.round(F.col("n_chars") / 500).alias("rank_score"))
    return S.drop_adjacent_of_many(h).select("id", "path", "line_start", "rank_score")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as concepts: the title is the first line, the description the second, headings all others."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("bundle_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("concept_id"), F.col("source").alias("type"), lines[0].alias("title"),
        F.when(F.size(lines) > 1, F.try_element_at(lines, F.lit(2))).alias("description"), F.array("lang", "source").alias("tags"), F.slice(lines, F.lit(3), F.size(lines)).alias("headings"),
        F.array(F.concat(F.lit("chars "), F.col("n_chars"))).alias("extensions"), F.array().cast("array<string>").alias("citations"), F.col("text").alias("body"),
    )


LOW = "translate(trim({}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def weighted_sql(q: str, terms: list[str], where: str, limit: int) -> str:
    low = LOW.format
    parts = [f"CASE WHEN cid = '{q}' THEN 1000 ELSE 0 END", f"CASE WHEN tl = '{q}' THEN 980 ELSE 0 END", f"CASE WHEN starts_with(cid, '{q}') AND cid <> '{q}' THEN 760 ELSE 0 END", f"CASE WHEN starts_with(tl, '{q}') AND tl <> '{q}' THEN 740 ELSE 0 END"]
    for t in terms:
        parts += [
            f"CASE WHEN contains(tl, '{t}') THEN 520 ELSE 0 END", f"CASE WHEN contains(source, '{t}') THEN 460 ELSE 0 END", f"CASE WHEN contains(lang, '{t}') OR contains(source, '{t}') THEN 430 ELSE 0 END", f"CASE WHEN contains(ds, '{t}') THEN 260 ELSE 0 END",
            f"CASE WHEN len(list_filter(hd, lambda h: contains({low('h')}, '{t}'))) > 0 THEN 230 ELSE 0 END", f"CASE WHEN contains('chars ' || n_chars, '{t}') THEN 210 ELSE 0 END", f"CASE WHEN contains(bd, '{t}') THEN 140 ELSE 0 END",
        ]
    return f"""WITH c AS (SELECT lang, source, n_chars, source || '/' || doc_id AS cid, string_split(text, chr(10))[1] AS title, {low("string_split(text, chr(10))[1]")} AS tl, coalesce({low("string_split(text, chr(10))[2]")}, '') AS ds,
      string_split(text, chr(10))[3:] AS hd, {low("text")} AS bd FROM documents),
    s AS (SELECT lang AS bundle_id, cid AS concept_id, title, CAST({' + '.join(parts)} AS INTEGER) AS score FROM c WHERE {where})
    SELECT bundle_id, concept_id, title, score FROM s WHERE score > 0 ORDER BY score DESC, bundle_id, concept_id, title LIMIT {limit}"""


@query("wiki_weighted_search", weighted_sql("src1 ion", ["src1", "ion"], "true", 100))
def wiki_weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weighted_search(concepts(spark, sf_dir), "src1 Ion", limit=100).select("bundle_id", "concept_id", "title", "score")


@query("wiki_search_indexed", weighted_sql("gen nation", ["gen", "nation"], "true", 100))
def wiki_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the index of three letters together: the rows of a full scan."""
    rows = concepts(spark, sf_dir)
    return S.weighted_search(rows, "Gen Nation", limit=100, grams=S.grams_of(rows)).select("bundle_id", "concept_id", "title", "score")


@query("wiki_search_filtered", weighted_sql("the", ["the"], "lang = 'en' AND source = 'src0'", 100))
def wiki_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weighted_search(concepts(spark, sf_dir), "the", limit=100, bundle="EN", kind="src0", tags=["en", "src0"]).select("bundle_id", "concept_id", "title", "score")


ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
#: Bytes as pairs of hexadecimal digits: without the rest of a broken character at the start, or a begun one at the end.
WHOLE_START = "regexp_replace({0}, '^([89AB][0-9A-F])+', '')"
WHOLE_END = "regexp_replace({0}, '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){{0,2}})$', '')"
_text = lambda part: ESCAPED.format(f"decode(unhex({part}))")
_before = _text(WHOLE_START.format("substr(h, greatest(p - 48, 1) * 2 - 1, (p - greatest(p - 48, 1)) * 2)"))
_behind = _text(WHOLE_END.format("substr(h, (p + 3) * 2 - 1, 96)"))


@query("snippet_match", f"WITH b AS (SELECT conv_id, turn, text, hex(encode(text)) AS h, strpos(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AS c FROM conversations), p AS (SELECT *, strlen(left(text, c - 1)) + 1 AS p FROM b) SELECT conv_id, turn, CASE WHEN c > 0 THEN left({_before} || '<mark>' || substr(text, c, 3) || '</mark>' || {_behind}, 160) END AS snippet FROM p")
def snippet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.mark(F.col("text"), "the", []).alias("snippet"))


@query("slugify_unique", r"""WITH s AS (SELECT doc_id, pos, trim(regexp_replace(lower(line), '[^\p{L}\p{M}\p{N}]+', '-', 'g'), '-') AS slug FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
n AS (SELECT doc_id, pos, slug, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS k FROM s)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n""")
def slugify_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("slug", slug(F.col("line")))
    k = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("pos"))
    return lines.withColumn("k", k).select("doc_id", "pos", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "k")).alias("slug"))


ITEMS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/abs/' WHEN 1 THEN '../' WHEN 2 THEN 'c:' WHEN 3 THEN 'a/b..c/' ELSE 'a\\..\\' END || doc_id AS path, text FROM documents"


@query("context_items", f"SELECT 'n' || doc_id AS id, 'unknown' AS kind, 'd' || doc_id AS label, CASE WHEN doc_id % 5 = 3 THEN path END AS path, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS summary FROM ({ITEMS}) ORDER BY doc_id DESC LIMIT 10")
def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten items as a knowledge page shows them."""
    n = F.col("doc_id").cast("string")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("/abs/", "../", "c:", "a/b..c/", "a\\..\\")]), (F.col("doc_id") % 5 + 1).cast("int"))
    hits = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), n).alias("id"), F.lit(None).cast("string").alias("node_type"), F.concat(F.lit("d"), n).alias("label"), F.concat(folder, n).alias("path"), F.col("text").alias("summary"), "doc_id")
    return S.context_items(hits, order=[F.desc("doc_id")])


TERMS_SQL = "SELECT doc_id, list_sort(list_filter(['audience ' || source, 'n ' || doc_id, 'ok ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, 'tags ' || lang, 'tags ' || (doc_id % 7)], lambda x: x IS NOT NULL)) AS terms FROM documents"


@query("extension_terms", TERMS_SQL)
def extension_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page's further fields: scalars and those in lists count, nested objects don't."""
    fields = F.struct(
        F.col("source").alias("audience"), F.col("doc_id").alias("n"), (F.col("doc_id") % 2 == 0).alias("ok"), F.struct(F.lit(1).alias("deep")).alias("object"),
        F.lit(None).cast("string").alias("nothing"), F.array(F.col("lang"), (F.col("doc_id") % 7).cast("string")).alias("tags"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", X.extension_terms(F.to_json(fields)).alias("terms"))
