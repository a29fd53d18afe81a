"""Token counts of whole texts by byte-pair merging, without making any token.

A pre-token starts as one symbol per byte, in a linked list; a heap holds its adjacent pairs by merge rank, then
place. The lowest pair is merged until no pair has a rank: the count is the initial symbols less the merges.
Stale heap entries show by their rank, which no longer is that of the pair at their place.

A text's count is the sum over its words, so a batch's words are split and numbered by Arrow and each distinct
one is counted once; counts of words met before are kept, two generations of at most ``most_words``. Words that
are letters and marks are parted here; all others, and texts holding control characters or not in normal form C,
go through the vocabulary file's own normalizer and pre-tokenizer. Special strings count one each, as the
library takes them by default.

Defined cases: null and empty texts count 0 bytes and 0 tokens; repeated rows count alike, a row each; an empty
table gives no rows; extra columns are ignored. A null doc_id stays null. Files of another model than byte-level
byte-pair merging, or with merges across white space, raise a ValueError.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import held, slices
from skein.llm.words import _CAPITAL, _LATIN, _MARKS, _ODD_SPACE

_PLACE = (1 << 32) - 1


class PairMerger:
    """``count(piece)``: how many tokens a pre-token of byte-level characters becomes."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a vocabulary of plain byte-pair merging is needed")
        numbers = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.first = {token: n for token, n in numbers.items() if len(token) == 1}
        self.last = {token[: len(token) - len(self.end)]: n for token, n in numbers.items() if token.endswith(self.end) and len(token) == 1 + len(self.end)}
        if len(self.first) < 256 or len(self.last) < 256:
            raise ValueError("a symbol for every byte is needed")
        self.width = max(numbers.values()).bit_length()
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[numbers[left] << self.width | numbers[right]] = rank
            self.made.append(numbers[left + right])

    def count(self, piece: str) -> int:
        symbols = [*map(self.first.__getitem__, piece[:-1]), self.last[piece[-1]]]
        return len(symbols) - self.merges(symbols)

    def merges(self, symbols: list[int]) -> int:
        """Merge in place, lowest rank first and then leftmost; how often that was possible."""
        ranks, made, width = self.ranks, self.made, self.width
        heap = [rank << 32 | i for i, (a, b) in enumerate(pairwise(symbols)) if (rank := ranks.get(a << width | b, -1)) >= 0]
        heapify(heap)
        n, done = len(symbols), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)  # stands behind the last one, and is no part of any pair
        while heap:
            top = heappop(heap)
            rank, i = top >> 32, top & _PLACE
            j = after[i]
            if symbols[i] < 0 or symbols[j] < 0 or ranks.get(symbols[i] << width | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = made[rank], -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (new := ranks.get(symbols[i] << width | symbols[k], -1)) >= 0:
                    heappush(heap, new << 32 | i)
            if h >= 0 and (new := ranks.get(symbols[h] << width | symbols[i], -1)) >= 0:
                heappush(heap, new << 32 | h)
            done += 1
        return done


class TokenCounts:
    """``count(texts)``: the tokens of each text, as an array."""

    def __init__(self, path: str, most_words: int = 200_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = PairMerger(spec["model"])
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        if self._pieces("Aa  bb,\tc") != self._pieces("Aa") + self._pieces("bb,") + self._pieces("c"):
            raise ValueError("a vocabulary whose tokens don't span white space is needed")
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]]]
        if odd:
            raise ValueError("special strings must be matched as they stand")
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.most_words = most_words
        self.known: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}
        # the short way holds only where letters and marks are pre-tokens of their own, in lower case
        self.short = self._pieces("Ab.,;") == ["ab", ".,;"]

    def _pieces(self, text: str) -> list[str]:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def _exact(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._counted(piece) for part in parts if part for piece in self._pieces(part))

    def _counted(self, piece: str) -> int:
        key = "\n" + piece  # no word begins so
        if (n := self.known.get(key)) is None:
            n = self.known[key] = self.old.get(key) or self.merger.count(piece)
        return n

    def _words(self, words: list[str], plain: bool) -> np.ndarray:
        """Counts of distinct words; ``plain`` ones are runs of Latin letters or of marks in lower case."""
        if len(self.known) > self.most_words:
            self.old, self.known = self.known, {"": 0}
        known, old, spell = self.known, self.old, self._spelled
        for word in words:
            if word not in known:
                n = old.get(word)
                known[word] = n if n is not None else self.merger.count(spell(word)) if plain else self._exact(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    @staticmethod
    def _spelled(run: str) -> str:
        return run if run.isascii() else "".join(map(BYTE_LEVEL.__getitem__, run.encode()))

    def count(self, texts: list[str | None]) -> np.ndarray:
        whole = [bool(text) and (_ODD_SPACE.search(text) is not None or not unicodedata.is_normalized("NFC", text)) for text in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if own else text or "" for text, own in zip(texts, whole, strict=True)], pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.string())
        counts = np.zeros(len(words), dtype=np.int64)
        lower = pc.utf8_lower(words)
        head, tail = pc.utf8_rtrim(lower, _MARKS), pc.utf8_ltrim(lower, _LATIN)
        short = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(lower))
        # capitals must be ones whose lower case is known to be the vocabulary's
        short = pc.and_(short, pc.equal(pc.binary_length(pc.utf8_ltrim(words, _LATIN + _CAPITAL)), pc.binary_length(tail)))
        short = short.to_numpy(zero_copy_only=False) & self.short
        for runs in (head, tail):
            runs = pc.filter(runs, pa.array(short)).dictionary_encode()
            counts[short] += self._words(runs.dictionary.to_pylist(), plain=True)[runs.indices.to_numpy()]
        others = np.flatnonzero(~short)
        counts[others] = self._words(words.take(pa.array(others)).to_pylist(), plain=False)
        sums = np.concatenate([[0], np.cumsum(counts[numbered.indices.to_numpy()])])[split.offsets.to_numpy()]
        found = np.diff(sums)
        for i in np.flatnonzero(whole):
            found[i] = self._exact(texts[i])
        return found


def _byte_level() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTE_LEVEL = _byte_level()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """A row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held("counts", tokenizer_path, lambda: TokenCounts(tokenizer_path))
        for batch in slices(batches, "text"):
            text = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counter.count(text.to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
