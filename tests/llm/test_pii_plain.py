"""Surrogates against a plain version: what is found and where each replacement goes, text by text."""

import pyarrow.parquet as pq
import regex

from skein.llm import pii

TITLE = regex.compile(rf"^(?:{pii.MALE}|{pii.FEMALE}|{pii.NEUTRAL})\.? ")
ENTITY = regex.compile(pii.ENTITY)
MORE = [
    "Dr. Anna Weber met us. Later Anna Weber left, and Weber wrote to anna.weber@x.org. Webers, Weber-Klein, Weber's book; weber?",
    "Anna Weber alone.", "Mr Li saw Li and Mrs Li Po. Po and Li Po. LI", "Before: Novak. Herr NOVAK and Frau Novak; Novak Novak", "Господин Иванов и Иванов. Иванова", None, "", "x" * 100_000 + " Mr Late Comer Comer",
]


def pieces(pattern, text):
    """The text between matches, and the matches."""
    between, found, at = [], [], 0
    for m in pattern.finditer(text):
        between.append(text[at : m.start()])
        found.append(m.group())
        at = m.end()
    return [*between, text[at:]], found


def plain(text, new):
    """The text with its entities and the further names of its people replaced; ``new`` holds each entity's replacement."""
    between, found = pieces(ENTITY, text)
    names = {}
    for entity in found:
        if TITLE.match(entity):
            name, other = TITLE.sub("", entity), TITLE.sub("", new[entity])
            names |= {name: other, name.split(" ")[-1]: other.split(" ")[-1]}
    if names:
        listed = "|".join(sorted(names, key=lambda n: (-len(n), n)))
        again = regex.compile(rf"{pii.EDGE}(?:{listed}){pii.END}(?!-\p{{L}})")
        between = [again.sub(lambda m: names[m.group()], b) for b in between]
    return between[0] + "".join(new[e] + b for e, b in zip(found, between[1:], strict=True)), len(found)


def test_every_text_is_that_of_the_plain_version(spark):
    texts = [*pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist(), *MORE]
    entities = sorted({e for t in texts if t for e in ENTITY.findall(t)})
    # each entity by itself tells its replacement; a secret that only its surroundings give away keeps them
    alone = [e if (m := ENTITY.match(e)) and m.group() == e else f"token='{e}'" for e in entities]
    rows = [(i, t) for i, t in enumerate([*texts, *alone])]
    out = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.surrogates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "key").collect()}
    assert len(out) == len(rows)
    new = {}
    for i, (entity, text) in enumerate(zip(entities, alone, strict=True), start=len(texts)):
        before, after = ("", "") if text == entity else ("token='", "'")
        found = out[i][0]
        assert found.startswith(before) and found.endswith(after)
        new[entity] = found[len(before) : len(found) - len(after)]
    assert all(new[e] != e for e in entities)
    for i, text in enumerate(texts):
        assert out[i] == ((None, 0) if text is None else plain(text, new))
    assert "Weber" not in out[len(texts) - len(MORE)][0].replace("Webers", "").replace("Weber-Klein", "")
