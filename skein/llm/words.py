"""Token ids of whole texts, by way of their distinct words.

The word tokenizer drops white space and never joins characters across it, so a text's ids are its
words' ids in order. A batch's words are split and numbered by Arrow; each distinct word is parted into
a run of letters and the marks behind it, and only runs not met before go to the tokenizer, in one call.
Words of another shape are parted by a regular expression or encoded by themselves. Texts holding control
characters that Python and the tokenizer class differently, or not in normal form C, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Python takes these for white space, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that are each a pre-token of their own after letters. No apostrophe: it may open a contraction.
_MARKS = ".,;:!?*$#%&@()[]{}\"/\\|+=~^-"
#: Lower-case Latin letters in normal form C, for the short way.
_LATIN = "".join(c for c in map(chr, [*range(0x61, 0x7B), *range(0xDF, 0x250)]) if c.islower() and len(c.upper()) == 1 and unicodedata.category(c) == "Ll")
_CAPITAL = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0xC0, 0x250)]) if len(c.lower()) == 1 and c.lower() in _LATIN and c != c.lower())
#: Letters, then marks, or anything else.
_PARTS = re.compile(r"^(?:([^\W\d_]*)([" + re.escape(_MARKS) + r"]*)|(.+))$", re.M)


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` at ``starts`` one after another, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=starts.dtype)], ends


class WordIds:
    """``encode(texts)``: each text's ids as bytes, little-endian of ``width`` bytes an id."""

    def __init__(self, path: str, width: int = 4, most_words: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for runs, which are lower case and normal already; the vocabulary is shared
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.kind = np.dtype(f"<u{width}")
        self.most_words = most_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            ends[number] = token.endswith("</w>")
        self.ends = ends
        # two generations: what is met again moves to the newer one, the older one is dropped when that is full
        self.by_run: dict[str, bytes] = {"": b""}
        self.old_runs: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _runs(self, runs: list[str]) -> None:
        """Ids of single pre-tokens; the end-of-word mark of the last id of each tells them apart."""
        for at in range(0, len(runs), 20_000):
            part = runs[at : at + 20_000]
            texts = [" ".join(part[i : i + 500]) for i in range(0, len(part), 500)]
            ids = np.concatenate([np.array(e.ids, dtype=self.kind) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or len(ids) != stops[-1]:
                for run in part:
                    self.by_run[run] = self._whole(run)
                continue
            data, stops = ids.tobytes(), (stops * self.kind.itemsize).tolist()
            self.by_run.update(zip(part, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))

    def _learn(self, runs: list[str]) -> None:
        if len(self.by_run) > self.most_words:
            self.old_runs, self.by_run = self.by_run, {"": b""}
        fresh = set(runs).difference(self.by_run)
        met = fresh.intersection(self.old_runs)
        self.by_run.update(zip(met, map(self.old_runs.__getitem__, met), strict=True))
        self._runs(list(fresh - met))

    def _others(self, words: list[str]) -> list[bytes]:
        """Words that are not Latin letters followed by marks."""
        special = {w for w in words if "Σ" in w or "İ" in w}  # the tokenizer lowers these by character
        parts = _PARTS.findall("\n".join("" if w in special else w for w in words).lower())
        self._learn([x for head, tail, _ in parts for x in (head, tail)])
        get = self.by_run.__getitem__
        # numbers that aren't digits are letters to Python's expression, not to the tokenizer
        return [self._whole(word) if other or word in special or head and not head.isalpha() else get(head) + get(tail) for word, (head, tail, other) in zip(words, parts, strict=True)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct words one after another, where each word's start, and how many they are."""
        lower = pc.utf8_lower(words)
        head, tail = pc.utf8_rtrim(lower, _MARKS), pc.utf8_ltrim(lower, _LATIN)
        short = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(lower))
        # the capitals must be ones whose lower case is known to be the tokenizer's
        short = pc.and_(short, pc.equal(pc.binary_length(pc.utf8_ltrim(words, _LATIN + _CAPITAL)), pc.binary_length(tail))).to_numpy(zero_copy_only=False)
        heads, tails = (pc.if_else(pa.array(short), x, "").dictionary_encode() for x in (head, tail))
        names = [*heads.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
        self._learn(names)
        data = list(map(self.by_run.__getitem__, names))
        odd = np.flatnonzero(~short)
        parts = np.column_stack([heads.indices.to_numpy(), tails.indices.to_numpy() + np.int32(len(heads.dictionary))])
        if len(odd):
            nothing = len(data)
            data.append(b"")
            parts[odd, 0], parts[odd, 1] = nothing + 1 + np.arange(len(odd)), nothing
            data += self._others(words.take(pa.array(odd)).to_pylist())
        sizes = np.fromiter(map(len, data), dtype=np.int32, count=len(data)) // self.kind.itemsize
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        ids, ends = _gather(np.frombuffer(b"".join(data), self.kind), starts[parts.ravel()], sizes[parts.ravel()])
        ends = ends[1::2]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return ids, starts, ends - starts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [bool(text) and (_ODD_SPACE.search(text) is not None or not unicodedata.is_normalized("NFC", text)) for text in texts]
        words = pc.utf8_split_whitespace(pa.array(["" if own else text or "" for text, own in zip(texts, whole, strict=True)], pa.large_string()))
        numbered = words.flatten().dictionary_encode()
        ids, starts, sizes = self._distinct(numbered.dictionary.cast(pa.string()))
        at = numbered.indices.to_numpy()
        ids, ends = _gather(ids, starts[at], sizes[at])
        ids, bounds = ids.tobytes(), np.concatenate([[0], ends])[words.offsets.to_numpy()] * self.kind.itemsize
        cut = map(ids.__getitem__, map(slice, bounds[:-1].tolist(), bounds[1:].tolist()))
        return [self._whole(text) if own else part for text, own, part in zip(texts, whole, cut, strict=True)]
