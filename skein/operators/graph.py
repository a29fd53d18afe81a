"""Property-graph operators over two tables: nodes (id, node_type, ...) and edges (id, edge_type, source_id, target_id, ...)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import last_segment, symbol_key
from skein.ontology import DECLARATIONS, RELATION_ENDS, SYMBOL_TARGETS
from skein.operators.storage import materialize

__all__ = ["DECLARATIONS", "SYMBOL_TARGETS"]
NODE_ORDER = ("neighbor_type", "neighbor_id")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities, edges, and all rows that the reified form has as nodes (an edge is a node there too)."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).withColumn("reified_nodes", F.col("nodes") + F.col("edges"))


def of_types(nodes: DataFrame, types: Iterable[str]) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def hop(nodes: DataFrame, edges: DataFrame, relation: str, source_types: Iterable[str] | None = None, target_types: Iterable[str] | None = None) -> DataFrame:
    """(a)-[relation]->(b) as a_* and b_* columns. Both ends are filtered before the joins."""
    side = lambda types, p: (of_types(nodes, types) if types else nodes).select(*[F.col(c).alias(f"{p}_{c}") for c in nodes.columns])
    e = edges.where(F.col("edge_type") == relation)
    return e.join(side(source_types, "a"), F.col("source_id") == F.col("a_id")).join(side(target_types, "b"), F.col("target_id") == F.col("b_id"))


def without(nodes: DataFrame, edges: DataFrame, relation: str, types: Iterable[str]) -> DataFrame:
    """Nodes of ``types`` that no edge of ``relation`` leaves."""
    return of_types(nodes, types).join(edges.where(F.col("edge_type") == relation).select(F.col("source_id").alias("id")), "id", "left_anti")


def symbol_lookup(nodes: DataFrame, name: str, types: Iterable[str], limit: int = 25) -> DataFrame:
    return of_types(nodes, types).where((F.col("label") == name) | (F.col("qualified_name") == name)).orderBy("id").limit(limit)


def fan(edges: DataFrame, nodes: DataFrame, relations: Iterable[str], incoming: bool, limit: int = 50) -> DataFrame:
    """Nodes with the most edges in or out, by relation: counted on ids alone, names joined for the few that stay."""
    key = "target_id" if incoming else "source_id"
    counted = edges.where(F.col("edge_type").isin(*relations)).groupBy("edge_type", F.col(key).alias("id")).agg(F.count("*").alias("degree"))
    best = counted.orderBy(F.desc("degree"), "edge_type", "id").limit(limit)
    return nodes.join(F.broadcast(best), "id").select("edge_type", "id", "node_type", "label", "degree")  # at most ``limit`` rows


def neighbors(nodes: DataFrame, edges: DataFrame, relations: list[str], starts: DataFrame | None = None) -> DataFrame:
    """One hop in both directions: origin, direction, relation, neighbor_id, neighbor_type, child_index, chain."""
    e = edges.where(F.col("edge_type").isin(*relations))
    chain = F.concat("edge_type", F.lit(":"), "source_id", F.lit("->"), "target_id").alias("chain")
    out = e.select(F.col("source_id").alias("origin"), F.lit("outgoing").alias("direction"), F.col("edge_type").alias("relation"), F.col("target_id").alias("neighbor_id"), "child_index", chain)
    back = e.select(F.col("target_id").alias("origin"), F.lit("incoming").alias("direction"), F.col("edge_type").alias("relation"), F.col("source_id").alias("neighbor_id"), "child_index", chain)
    both = out.unionByName(back)
    if starts is not None:
        both = both.join(starts.select(F.col("id").alias("origin")).distinct(), "origin", "left_semi")
    return both.join(nodes.select(F.col("id").alias("neighbor_id"), F.col("node_type").alias("neighbor_type")), "neighbor_id")


def relation_rank(relation: Column, relations: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in relations]), relation)


CONTEXT = "position int, depth int, direction string, relation string, neighbor_type string, neighbor_id string, child_index bigint, chain string"


def context(nodes: DataFrame, edges: DataFrame, start: str, relations: list[str], limit: int, max_depth: int = 1, syntax_first: bool = False) -> DataFrame:
    """Bounded breadth-first context of one node."""
    return contexts(nodes, edges, [start], relations, limit, max_depth, syntax_first).drop("start")


def contexts(nodes: DataFrame, edges: DataFrame, starts: list[str], relations: list[str], limit: int, max_depth: int = 1, syntax_first: bool = False) -> DataFrame:
    """Bounded breadth-first contexts of some nodes, each by itself: (start, position, ...).

    A frontier is a queue: each of its nodes asks every relation in order, outgoing then incoming, for at
    most as many neighbours as are still wanted; a (direction, relation, type, id) counts once. Neighbours of
    one question come by child index, type and id. Levels are few and a frontier is at most ``limit``
    nodes, so frontiers are held as rows on the driver while each level of all of them is one distributed join.
    """
    spark = nodes.sparkSession
    starts = list(dict.fromkeys(starts))
    rows: dict[str, list[tuple]] = {s: [] for s in starts}
    seen: dict[str, set[tuple]] = {s: set() for s in starts}
    frontiers = {s: [s] for s in starts} if limit > 0 and max_depth > 0 else {}
    for depth in range(max_depth):
        frontiers = {s: f for s, f in frontiers.items() if f and len(rows[s]) < limit}
        if not frontiers:
            break
        # those seen before are at most ``limit`` more than are wanted
        asked = [(s, n, origin, limit - len(rows[s]), limit - len(rows[s]) + len(seen[s]) + limit * limit) for s, f in frontiers.items() for n, origin in enumerate(f)]
        asked = spark.createDataFrame(asked, "start string, turn int, origin string, wanted int, most int")
        level = neighbors(nodes, edges, relations).join(F.broadcast(asked), "origin")  # at most ``limit`` rows a start
        order = [F.asc("turn"), relation_rank(F.col("relation"), relations).asc(), F.desc("direction"), F.asc_nulls_last("child_index"), F.asc("neighbor_type"), F.asc("neighbor_id")]
        place = F.row_number().over(Window.partitionBy("start", "turn", "relation", "direction").orderBy(*order[3:]))
        level = level.withColumn("place", place).where(F.col("place") <= F.col("wanted"))
        level = level.withColumn("nth", F.row_number().over(Window.partitionBy("start").orderBy(*order))).where(F.col("nth") <= F.col("most"))
        found = level.orderBy("start", "nth").collect()
        upcoming: dict[str, list[str]] = {}
        question, left = None, 0
        for r in found:
            own = rows[r["start"]]
            if len(own) >= limit:
                continue
            if (r["start"], r["turn"], r["relation"], r["direction"]) != question:
                question, left = (r["start"], r["turn"], r["relation"], r["direction"]), limit - len(own)
            if r["place"] > left:
                continue
            key = (r["direction"], r["relation"], r["neighbor_type"], r["neighbor_id"])
            if key in seen[r["start"]]:
                continue
            seen[r["start"]].add(key)
            upcoming.setdefault(r["start"], []).append(r["neighbor_id"])
            own.append((len(own), depth + 1, r["direction"], r["relation"], r["neighbor_type"], r["neighbor_id"], r["child_index"], r["chain"]))
        frontiers = upcoming
    out = []
    for s, own in rows.items():
        if syntax_first:  # children first by index and id, the rest as found
            own.sort(key=lambda r: (0, r[6] if r[6] is not None else -1, r[5]) if r[3] == "SyntaxChild" else (1, 0, ""))
        out += [(s, i, *r[1:]) for i, r in enumerate(own)]
    return spark.createDataFrame(out, f"start string, {CONTEXT}")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, both_ways: bool = True) -> DataFrame:
    """(id, depth): every node within ``max_depth`` hops of ``starts`` (id), with the least number of hops.

    Each level joins only the newest nodes and drops those met before, so paths don't multiply. Links and levels are
    stored, so a plan reads them instead of holding all levels before it."""
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    if both_ways:
        links = links.union(links.select(F.col("b"), F.col("a")))
    links = materialize(links.distinct(), "links") if max_depth > 1 else links
    found = newest = starts.select("id", F.lit(0).alias("depth")).distinct()
    for depth in range(1, max_depth + 1):
        upcoming = links.join(newest.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        newest = upcoming.join(found.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"))
        if depth < max_depth:
            newest = materialize(newest, "frontier")
        found = found.unionByName(newest)
    return found


def resolve_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the types of both ends; an end that no node has gives null.

    Ids are looked up in hashed partitions of the nodes, so that no edges are sorted, of which there are more.
    """
    ends = nodes.select("id", "node_type").hint("shuffle_hash")
    return edges.join(ends.select(F.col("id").alias("source_id"), F.col("node_type").alias("from_type")), "source_id", "left").join(ends.select(F.col("id").alias("target_id"), F.col("node_type").alias("to_type")), "target_id", "left")


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A message for each end of an edge that no node has.

    Which ids are missing is found among the distinct ends, so no edge is shuffled for that; edges meet only these ids, in
    place where they are few. An end that is null is missing.
    """
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    missing = materialize(ends.join(nodes.select("id"), "id", "left_anti"), "missing")
    out = None
    for side in ("source", "target"):
        lost = edges.join(missing.select(F.col("id").alias("missing_")), F.col(f"{side}_id").eqNullSafe(F.col("missing_")), "left_semi")
        part = lost.select(F.col("id").alias("edge_id"), F.concat(F.lit("edge "), "id", F.lit(f" references missing {side} node "), f"{side}_id").alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def allowed(relation: Column, from_type: Column, to_type: Column) -> Column:
    """Whether the relation may join these types; relations not named may join any."""
    ok = None
    for name, (sources, targets) in RELATION_ENDS.items():
        test = from_type.isin(*sources) & to_type.isin(*targets)
        ok = F.when(relation == name, test) if ok is None else ok.when(relation == name, test)
    return ok.otherwise(True)


def constrained(resolved: DataFrame) -> DataFrame:
    """Edges whose ends their relation allows; the others drop silently."""
    return resolved.where(allowed(F.col("edge_type"), F.col("from_type"), F.col("to_type")))


def connectors(resolved: DataFrame) -> DataFrame:
    """Two rows per edge: from the source to the edge, and from the edge to the target; distinct."""
    src = resolved.select(F.col("edge_type").alias("relation"), F.lit("source").alias("side"), F.col("from_type"), F.col("edge_type").alias("to_type"), F.col("source_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("source").alias("role"))
    dst = resolved.select(F.col("edge_type").alias("relation"), F.lit("target").alias("side"), F.col("edge_type").alias("from_type"), F.col("to_type"), F.col("id").alias("from_id"), F.col("target_id").alias("to_id"), F.lit("target").alias("role"))
    return src.unionByName(dst).distinct()


def merge_first(rows: DataFrame, keys: list[str], order: str, strings: list[str], others: list[str], kept: list[str], json_columns: list[str] = (), defaults: dict[str, float] | None = None) -> DataFrame:
    """One row per key: of ``strings`` the first that isn't empty, of ``others`` the first that isn't null, of
    ``json_columns`` the first that isn't an empty value, of ``kept`` the first row's, and of ``defaults`` the
    first value that isn't the default. Partial aggregation on each side of the shuffle; no group is gathered."""
    first = lambda c, test: F.min_by(F.when(test, F.col(c)), F.when(test, F.col(order)))
    aggregates = [F.coalesce(first(c, F.col(c).isNotNull() & (F.col(c) != "")), F.lit("")).alias(c) for c in strings]
    aggregates += [first(c, F.col(c).isNotNull()).alias(c) for c in others]
    aggregates += [F.min_by(F.struct(F.col(c)), F.col(order))[c].alias(c) for c in kept]
    empty = ("", "null", "{}", "[]", '""')
    aggregates += [F.coalesce(first(c, F.col(c).isNotNull() & ~F.trim(F.col(c)).isin(*empty)), F.min_by(F.struct(F.col(c)), F.col(order))[c]).alias(c) for c in json_columns]
    aggregates += [F.coalesce(first(c, F.col(c) != v), F.lit(v)).alias(c) for c, v in (defaults or {}).items()]
    return rows.groupBy(*keys).agg(*aggregates)


def first_type(nodes: DataFrame, order: str) -> DataFrame:
    """Of ids that stand under several types the first one's type counts."""
    return nodes.groupBy("id").agg(F.min_by("node_type", order).alias("node_type"))


def latest_definitions(references: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """``references`` (path, at, ``key``, ...) with ``found``: the def_id of the latest definition (path, key, at, def_id) above.

    An as-of join without a range condition: both tables are stacked, and the last definition seen so far is
    carried forward within the key. At one position the reference comes first.
    """
    rest = [c for c in references.columns if c not in ("path", "at", key)]
    nothing = F.lit(None).cast("string")
    left = references.select("path", F.col(key).alias("_key"), "at", F.lit(1).alias("_kind"), F.struct(*rest).alias("_rest"), nothing.alias("_def"))
    right = definitions.select("path", F.col("key").alias("_key"), "at", F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_rest"].dataType).alias("_rest"), F.col("def_id").alias("_def"))
    carried = F.last("_def", ignorenulls=True).over(Window.partitionBy("path", "_key").orderBy("at", F.desc("_kind"), "_def").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stacked = left.unionByName(right).withColumn("found", carried).where("_kind = 1")
    return stacked.select("path", "at", F.col("_key").alias(key), *[F.col("_rest")[c].alias(c) for c in rest], "found")


def resolve_labels(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """The latest earlier definition of each reference's label in its file, tried whole and then after the last dot.

    references: path, ref_id, label, at. definitions: path, def_id, label, at. A reference without one gets a
    placeholder symbol.
    """
    keyed = definitions.select("path", symbol_key(F.col("label")).alias("key"), "def_id", "at")
    refs = references.withColumn("whole_key", symbol_key(F.col("label"))).withColumn("tail_key", symbol_key(last_segment(F.col("label"))))
    joined = latest_definitions(refs, keyed, "whole_key").withColumnRenamed("found", "whole")
    joined = latest_definitions(joined, keyed, "tail_key").withColumnRenamed("found", "tail")
    target = F.coalesce("whole", "tail")
    return joined.select("path", "ref_id", "label", F.coalesce(target, F.concat(F.lit("Symbol:"), "path", F.lit("|"), "label")).alias("target_id"), target.isNull().alias("placeholder"))
