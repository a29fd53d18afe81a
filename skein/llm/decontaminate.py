"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with up to ``rate`` times its length in edits. It is split into one piece
more than that budget, so each such occurrence holds some piece unchanged. One automaton finds all pieces
of a block of items in a text; around each hit Myers' bit-parallel algorithm computes the least edit
distance of the item to any substring.

Items and texts are compared as lower-case words with single spaces, closed by spaces at both ends, so
short items match whole words only. Items come in blocks of bounded size; each block is broadcast and read
against all documents. At most BLOCKS blocks are broadcast for one pass over the documents: where there are
more, the rows found so far are stored, and their blocks given up, before the next ones are taken.

Defined cases: null and empty texts hold nothing; items without a letter or digit match nothing; repeated
items are reported under each id; repeated rows are reported each; equal distances give the leftmost end;
extra columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held, materialize, slices, unique_names

WORD = re.compile(r"[^\W_]+")
#: Bytes of item text in a block.
BLOCK_BYTES = 4 << 20
#: Blocks that are broadcast at one time.
BLOCKS = 8


def normalized(text: str | None) -> str:
    return f" {' '.join(WORD.findall(text)).lower()} " if text else "  "


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one pattern: bit masks by character, distances at every end in a text."""

    def __init__(self, text: str):
        self.size, self.top, self.all = len(text), 1 << (len(text) - 1), (1 << len(text)) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """Least distance to a substring, if at most ``most``, and its leftmost end."""
        every, top, get = self.all, self.top, self.masks.get
        plus, minus, score, found = every, 0, self.size, None
        for j, c in enumerate(text):
            eq = get(c, 0)
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | x
            up = (minus | ~(d | plus)) & every
            down = plus & d
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score <= most:
                    found, most = (score, j + 1), score - 1
                    if not score:
                        break
            up, down = up << 1 & every, down << 1 & every
            plus, minus = (down | ~(d | up)) & every, up & d
        return found


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, text, budget(len(text), rate)) for i, text in items]
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for place, piece in pieces(text, edits):
                at.setdefault(piece, []).append((n, place))
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, stop) per item found: its best occurrence, as places in ``text``."""
        if self.empty or not text:
            return []
        line = normalized(text)
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(line):
            for n, place in uses:
                starts.setdefault(n, set()).add(end + 1 - size - place)
        found = []
        for n, at in starts.items():
            item_id, item, edits = self.items[n]
            if n not in self.patterns:
                self.patterns[n] = (Pattern(item), Pattern(item[::-1]))
            best = None
            for low, high in _merged(sorted(at), edits, len(item)):
                low = max(0, low)
                hit = self.patterns[n][0].best(line[low:high], edits if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], low + hit[1])
                    if not best[0]:
                        break
            if best:
                distance, stop = best
                back = self.patterns[n][1].best(line[max(0, stop - len(item) - edits) : stop][::-1], distance)
                found.append((item_id, distance, stop - back[1] if back else stop - len(item), stop))
        return _in_text(text, found) if found else []


def _merged(starts: list[int], edits: int, size: int) -> Iterator[tuple[int, int]]:
    """Windows around likely starts, joined where they overlap."""
    low, high = starts[0] - edits, starts[0] + size + edits
    for s in starts[1:]:
        if s - edits > high:
            yield low, high
            low = s - edits
        high = s + size + edits
    yield low, high


def _in_text(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Places in the normalized line as places in the text."""
    line_to_text, at = [0], 1
    for m in WORD.finditer(text):
        n = len(m.group().lower())
        line_to_text += [min(m.start() + i, m.end()) for i in range(n)] + [m.end()]
        at += n + 1
    last = len(line_to_text) - 1
    return [(i, d, line_to_text[min(max(a, 0) + 1, last)], line_to_text[min(max(b - 1, 0), last)]) for i, d, a, b in found]


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalized items (item_id, text), in blocks of at most BLOCK_BYTES (one item at least)."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    for r in rows.toLocalIterator():
        text = normalized(r["text"])
        if not text.strip():
            continue
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.06) -> DataFrame:
    """A row per document and item it holds: doc_id, item_id, distance, start, stop (places in the text)."""
    schema, context = "doc_id bigint, item_id bigint, distance int, start int, stop int", docs.sparkSession.sparkContext
    texts, found, live = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), None, []
    for block in item_blocks(items):
        if len(live) == BLOCKS:
            found = materialize(found, "matches")
            while live:
                live.pop().unpersist()
        shared, key = context.broadcast(block), uuid.uuid4().hex
        live.append(shared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = held("pieces", key, lambda: Matcher(shared.value, rate))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            for batch in slices(batches, "text"):
                rows = [(doc_id, *hit) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in matcher.find(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "stop"])

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.06) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    (flag,), live = unique_names(docs, "holds_item"), []
    for block in item_blocks(items):
        if len(live) == BLOCKS:
            docs = materialize(docs, "clean")
            while live:
                live.pop().unpersist()
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        live.append(shared)

        @F.pandas_udf("boolean")
        def holds(texts, shared=shared, key=key):  # noqa: ANN001, ANN202
            matcher = held("pieces", key, lambda: Matcher(shared.value, rate))
            return texts.map(lambda t: bool(matcher.find(t)))

        docs = docs.withColumn(flag, holds(F.col("text").cast("string"))).where(~F.col(flag)).drop(flag)
    return docs
