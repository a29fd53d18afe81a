"""Ranked search: postings, BM25, rank blending, layers, weighted field search and snippets.

Documents are rows (id, layer, index_order, text, ...). The index is three tables: postings (term, id, tf),
lexicon (term, df) and lengths (id, layer, index_order, length). Statistics cover all layers; a layer is
chosen after scoring. A search joins the few query terms to the postings, so only their postings are read,
and sums per document with partial aggregation before the one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import ascii_lower, code_terms, escape_html, is_safe_path, plain_code_terms, round6, truncated
from skein.operators import ordered
from skein.operators.storage import materialize

K1, B = 1.2, 0.75
QUERY_TERMS = 32
#: Entity weights by node type (fixed values); types not named weigh 0.5.
ENTITY_WEIGHT = {
    1.0: ("Class", "Function", "Method", "Module", "Variable", "Parameter", "Field", "Enum", "Interface", "Trait", "Struct"),
    0.8: ("File", "DocumentationChunk", "DocumentationSource"),
    0.6: ("CallExpression", "Reference", "ImportDeclaration", "Assignment"),
    0.25: ("Symbol",),
    0.2: ("Dependency",),
    0.1: ("SyntaxCapture",),
}
#: Weights of the knowledge search (fixed values).
BOOSTS = {"exact_id": 1000, "exact_title": 980, "prefix_id": 760, "prefix_title": 740}
TERM_BOOSTS = {"title": 520, "type": 460, "tag": 430, "description": 260, "heading": 230, "extension": 210, "citation": 180, "body": 140}


@dataclass
class Index:
    postings: DataFrame
    lexicon: DataFrame
    lengths: DataFrame
    totals: DataFrame  # one row: n, tokens

    def write(self, path: str) -> Index:
        """Store the tables, postings clustered by term so that a query's terms touch few files."""
        clustered(self.postings).write.mode("overwrite").parquet(f"{path}/postings")
        clustered(self.lexicon).write.mode("overwrite").parquet(f"{path}/lexicon")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")
        return read_index(self.postings.sparkSession, path)

    def problems(self) -> DataFrame:
        """Rows that break an invariant: document frequencies, lengths and totals must agree with the postings."""
        df = self.postings.groupBy("term").agg(F.count("*").alias("found"))
        wrong_df = df.join(self.lexicon, "term", "full").where(~F.col("found").eqNullSafe(F.col("df"))).select(F.lit("lexicon").alias("part"), F.col("term").alias("key"))
        sums = self.postings.groupBy("id").agg(F.sum("tf").alias("found"))
        wrong_length = self.lengths.join(sums, "id", "left").where(F.coalesce("found", F.lit(0)) != F.col("length")).select(F.lit("length").alias("part"), F.col("id").cast("string").alias("key"))
        now = self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
        wrong_totals = now.exceptAll(self.totals).select(F.lit("totals").alias("part"), F.col("n").cast("string").alias("key"))
        return wrong_df.union(wrong_length).union(wrong_totals)


#: An index's tables, in the order in which each follows from those before it.
PARTS = ("postings", "lexicon", "lengths", "totals")


def clustered(df: DataFrame) -> DataFrame:
    keys = [c for c in ("term", "gram", "id") if c in df.columns]
    return df.repartitionByRange(keys[0]).sortWithinPartitions(*keys)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in PARTS))


def index_tables(documents: DataFrame | Callable[[dict[str, DataFrame]], DataFrame]) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """The index's tables for a store that writes them one by one: texts are tokenized for the postings alone.

    ``documents`` may be a function of the tables written before.
    """
    of = documents if callable(documents) else lambda written: documents
    return {
        "postings": lambda written: clustered(postings_of(of(written))),
        "lexicon": lambda written: clustered(written["postings"].groupBy("term").agg(F.count("*").alias("df"))),
        "lengths": lambda written: _lengths(of(written), written["postings"]),
        "totals": lambda written: _totals(written["lengths"]),
    }


def store_index(documents: DataFrame, path: str) -> Index:
    """Build and store an index, each table from those stored before it."""
    spark, written = documents.sparkSession, {}
    for name, made in index_tables(documents).items():
        made(written).write.mode("overwrite").parquet(f"{path}/{name}")
        written[name] = spark.read.parquet(f"{path}/{name}")
    return Index(*written.values())


def postings_of(documents: DataFrame) -> DataFrame:
    occurrences = documents.select("id", F.explode(code_terms(F.coalesce("text", F.lit("")))).alias("term"))
    return occurrences.groupBy("term", "id").agg(F.count("*").alias("tf"))


def _lengths(documents: DataFrame, postings: DataFrame) -> DataFrame:
    sums = postings.groupBy("id").agg(F.sum("tf").alias("length"))
    return documents.select("id", "layer", "index_order").join(sums, "id", "left").select("id", "layer", "index_order", F.coalesce("length", F.lit(0)).alias("length"))


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))


def indexed_text(fields: list[str]) -> Column:
    """The searchable fields as one text."""
    return F.concat_ws(" ", *[F.col(f) for f in fields])


def build_index(documents: DataFrame) -> Index:
    """From (id, layer, index_order, text): term frequencies by document, and the counts over all documents."""
    postings = postings_of(documents)
    lexicon = postings.groupBy("term").agg(F.count("*").alias("df"))
    lengths = documents.select("id", "layer", "index_order", F.size(code_terms(F.coalesce("text", F.lit("")))).cast("bigint").alias("length"))
    return Index(postings, lexicon, lengths, _totals(lengths))


def kept_index(documents: DataFrame) -> Index:
    """``build_index`` with its postings and lengths written aside, each from one pass over the texts: for callers that read them more than once."""
    made = build_index(documents)
    postings, lengths = materialize(made.postings, "postings"), materialize(made.lengths, "lengths")
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), lengths, _totals(lengths))


def query_terms(query: str) -> list[str]:
    """At most 32 distinct terms, in order of appearance; the same terms as the index has."""
    return list(dict.fromkeys(plain_code_terms(query)))[:QUERY_TERMS]


def bm25(index: Index, query: str) -> DataFrame:
    """(id, layer, index_order, score) of every document with a query term; scores rounded to six places."""
    terms = query_terms(query)
    hits = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.where(F.lit(False))
    lexicon = index.lexicon.where(F.col("term").isin(terms)) if terms else index.lexicon.where(F.lit(False))
    n, df, tf = F.col("n").cast("double"), F.col("df").cast("double"), F.col("tf").cast("double")
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    average = F.col("tokens").cast("double") / F.col("n")
    ratio = F.when(average > 0, F.col("length") / average).otherwise(0.0)
    part = idf * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * ratio))
    scored = (
        hits.join(F.broadcast(lexicon), "term")  # at most 32 rows
        .join(index.lengths, "id")
        .crossJoin(F.broadcast(index.totals))  # one row
        .groupBy("id", "layer", "index_order")
        .agg(F.sum(part).alias("score"))
    )
    return scored.withColumn("score", round6(F.col("score")))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "index_order", "id").limit(k)


def entity_weight(node_type: Column) -> Column:
    out = None
    for weight, kinds in ENTITY_WEIGHT.items():
        out = F.when(node_type.isin(*kinds), weight) if out is None else out.when(node_type.isin(*kinds), weight)
    return out.otherwise(0.5)


def lexical(query: str, label: Column, qualified_name: Column, path: Column) -> Column:
    """How the whole query stands in the names: equal 1, contained 0.8, in the path 0.5."""
    q = "".join(c.lower() if c.isascii() else c for c in query)
    if not q:
        return F.lit(0.0)
    label, name, path = (ascii_lower(F.coalesce(c, F.lit(""))) for c in (label, qualified_name, path))
    return F.when((label == q) | (name == q), 1.0).when(label.contains(q) | name.contains(q), 0.8).when(path.contains(q), 0.5).otherwise(0.0)


def rank(hits: DataFrame, query: str) -> DataFrame:
    """Blend the score (over its layer's best), the names and the type: adds fts, lexical, entity, rank_score."""
    best = F.max("score").over(Window.partitionBy("layer"))
    out = hits.withColumn("fts", F.when(best > 0, F.col("score") / best).otherwise(0.0))
    out = out.withColumn("lexical", lexical(query, F.col("label"), F.col("qualified_name"), F.col("path"))).withColumn("entity", entity_weight(F.col("node_type")))
    return out.withColumn("rank_score", round6(0.25 * F.col("fts") + 0.25 * F.col("lexical") + 0.5 * F.col("entity")))


def rank_order() -> list[Column]:
    return [F.desc("rank_score"), F.asc("index_order"), F.asc("path"), F.asc_nulls_first("line_start"), F.asc("id")]


def drop_adjacent(ranked: DataFrame) -> DataFrame:
    """Of hits with one id that stand next to each other in rank order only the first stays."""
    before = F.lag("id").over(Window.partitionBy("layer").orderBy(*rank_order()))
    return ranked.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("id"))).drop("before")


def drop_adjacent_of_many(ranked: DataFrame) -> DataFrame:
    """``drop_adjacent`` for any number of hits: dealt by range of their order, not by layer."""
    rows = ordered.before(ordered.placed(ranked, ["layer", *rank_order()], "ranked"), F.struct("layer", "id"), "before")
    return rows.where(~F.col("before").eqNullSafe(F.struct("layer", "id"))).select(*ranked.columns)


def merge_layers(ranked: DataFrame, layer: str, limit: int) -> DataFrame:
    """Hits of one layer, or for ``hybrid`` semantic ones first and syntax ones in what is left; adds position."""
    if layer != "hybrid":
        ranked = ranked.where(F.col("layer") == layer)
    ordinal = F.when(F.col("layer") == "semantic", 0).otherwise(1)
    chosen = ranked.withColumn("ordinal", ordinal).orderBy("ordinal", *rank_order()).limit(limit)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("ordinal", *rank_order()))).drop("ordinal")


def search(index: Index, nodes: DataFrame, query: str, layer: str = "semantic", limit: int = 3) -> DataFrame:
    """Score, take at most 10 to 50 candidates per layer, hydrate, rank, drop repeats, merge layers."""
    candidates = max(10, min(limit, 50))
    scored = bm25(index, query)
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("score"), "index_order", "id"))).where(F.col("place") <= candidates).drop("place")
    hydrated = nodes.join(F.broadcast(best), "id")  # candidates that have no node drop out
    return merge_layers(drop_adjacent(rank(hydrated, query)), layer, limit)


MOST_ITEMS, ITEM_SUMMARY = 10, 240


def context_items(hits: DataFrame, limit: int = MOST_ITEMS, order: list[Column] | None = None) -> DataFrame:
    """Graph hits as the items a knowledge page shows: 1 to 10 of them, summaries cut, paths that leave the repository nulled."""
    limit = max(1, min(limit, MOST_ITEMS))
    rows = (hits.orderBy(*order) if order else hits).limit(limit).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    return rows.select("id", F.coalesce("node_type", F.lit("unknown")).alias("kind"), "label", F.when(is_safe_path(F.col("path")), F.col("path")).alias("path"), truncated(F.col("summary"), ITEM_SUMMARY).alias("summary"))


def weighted_search(documents: DataFrame, query: str, limit: int = 20, bundle: str | None = None, kind: str | None = None, tags: list[str] | None = None, grams: DataFrame | None = None) -> DataFrame:
    """Knowledge search over (bundle_id, concept_id, type, title, description, tags, headings, extensions,
    citations, body): sums of boosts, the fields that matched, and a marked snippet. With ``grams`` (of ``grams_of``) only
    documents that may match are read."""
    text = lambda c: ascii_lower(F.trim(F.coalesce(c, F.lit(""))))
    q = "".join(c.lower() if c.isascii() else c for c in query.strip())
    terms = list(dict.fromkeys("".join(c.lower() if c.isascii() else c for c in t) for t in __import__("re").findall(r"[^\W_]+", query)))
    if not q:
        return _weighted(documents.where(F.lit(False)), q, terms, text).withColumn("snippet", snippet(q, terms)).limit(limit)
    found = documents if grams is None else candidates(documents, grams, q, terms)
    if bundle is not None:
        found = found.where(text(F.col("bundle_id")) == q_of(bundle))
    if kind is not None:
        found = found.where(text(F.col("type")) == q_of(kind))
    for tag in tags or []:
        found = found.where(F.exists("tags", lambda t: text(t) == q_of(tag)))
    hits = _weighted(found, q, terms, text)
    best = hits.where("score > 0").orderBy(F.desc("score"), "bundle_id", "concept_id", "title").limit(limit or 20)
    return best.withColumn("snippet", snippet(q, terms))  # of the rows that are left


GRAM = 3


def _pieces(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def grams_of(documents: DataFrame) -> DataFrame:
    """(gram, bundle_id, concept_id): every three letters that stand together in a field of a document, once."""
    none = F.array().cast("array<string>")
    fields = F.concat(F.array("concept_id", "title", "type", "description", "body"), *[F.coalesce(F.col(c), none) for c in ("tags", "headings", "extensions", "citations")])
    text = ascii_lower(F.array_join(fields, "\u0000"))  # what goes over the end of a field is in no term
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    return documents.select("bundle_id", "concept_id", F.explode(found).alias("gram")).select("gram", "bundle_id", "concept_id")


def candidates(documents: DataFrame, grams: DataFrame, q: str, terms: list[str]) -> DataFrame:
    """The documents that a search must look at: those that hold all the grams of one of its terms.

    A term of fewer than three letters may stand anywhere, so with one all documents are looked at.
    """
    wanted = terms or [q]
    if any(len(t) < GRAM for t in wanted):
        return documents
    needed = {t: _pieces(t) for t in wanted}
    hits = grams.where(F.col("gram").isin(sorted({g for some in needed.values() for g in some}))).groupBy("bundle_id", "concept_id").agg(F.collect_set("gram").alias("held"))  # at most the query's grams
    whole = F.lit(False)
    for some in needed.values():
        whole = whole | (F.size(F.array_except(F.array(*[F.lit(g) for g in some]), "held")) == 0)
    return documents.join(hits.where(whole).select("bundle_id", "concept_id"), ["bundle_id", "concept_id"], "left_semi")


def q_of(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text.strip())


def _weighted(documents: DataFrame, q: str, terms: list[str], text) -> DataFrame:  # noqa: ANN001
    concept, title = text(F.col("concept_id")), text(F.col("title"))
    some = lambda column: (lambda t: F.exists(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: text(v).contains(t)))
    holds = {
        "title": lambda t: title.contains(t),
        "type": lambda t: text(F.col("type")).contains(t),
        "tag": some("tags"),
        "description": lambda t: text(F.col("description")).contains(t),
        "heading": some("headings"),
        "extension": some("extensions"),
        "citation": some("citations"),
        "body": lambda t: text(F.col("body")).contains(t),
    }
    score, fields = F.lit(0), {}
    for test, boost, field in ((concept == q, "exact_id", "concept_id"), (title == q, "exact_title", "title"), (concept.startswith(q) & (concept != q), "prefix_id", "concept_id"), (title.startswith(q) & (title != q), "prefix_title", "title")):
        score = score + F.when(test, BOOSTS[boost]).otherwise(0)
        fields[field] = fields.get(field, F.lit(False)) | test
    for t in terms:
        for field, test in holds.items():
            score = score + F.when(test(t), TERM_BOOSTS[field]).otherwise(0)
            fields[field] = fields.get(field, F.lit(False)) | test(t)
    matched = F.array_compact(F.array(*[F.when(fields[f], F.lit(f)) for f in sorted(fields)]))
    return documents.withColumn("score", score).withColumn("matched_fields", matched)


RADIUS, SNIPPET_LENGTH = 48, 160


def snippet(q: str, terms: list[str]) -> Column:
    """The first field with a match, marked: up to 48 bytes on either side, escaped, 160 characters at most."""
    empty = F.array().cast("array<string>")
    fields = F.concat(F.array("title"), F.when(F.col("description").isNotNull(), F.array("description")).otherwise(empty), *[F.coalesce(F.col(c), empty) for c in ("headings", "extensions", "citations")], F.array("body"))
    return F.try_element_at(F.filter(F.transform(fields, lambda f: mark(f, q, terms)), lambda s: s.isNotNull()), F.lit(1)) if q else F.lit(None).cast("string")


def mark(field: Column, q: str, terms: list[str]) -> Column:
    """Places are bytes: the field's bytes stand as ISO-8859-1 characters until the parts are cut."""
    raw = F.decode(F.encode(field, "UTF-8"), "ISO-8859-1")
    lower = ascii_lower(raw)
    place = None
    for n, t in enumerate([q, *terms]):
        data = t.encode().decode("iso-8859-1")
        at = F.locate(data, lower)
        here = F.when(at > 0, F.struct(at.alias("at"), F.lit(n).alias("n"), F.lit(len(data)).alias("size")))
        place = here if place is None else F.least(place, here)
    start = F.greatest(place["at"] - RADIUS, F.lit(1))
    back = lambda s: F.decode(F.encode(s, "ISO-8859-1"), "UTF-8")
    # characters that the radius cuts in two are left out
    prefix = back(F.regexp_replace(F.substring(raw, start, place["at"] - start), r"^[\x80-\xBF]+", ""))
    matched = back(F.substring(raw, place["at"], place["size"]))
    broken = r"(?:[\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF7][\x80-\xBF]{0,2})$"
    suffix = back(F.regexp_replace(F.substring(raw, place["at"] + place["size"], F.lit(RADIUS)), broken, ""))
    return F.when(place.isNotNull(), F.left(F.concat(escape_html(prefix), F.lit("<mark>"), escape_html(matched), F.lit("</mark>"), escape_html(suffix)), F.lit(SNIPPET_LENGTH)))
