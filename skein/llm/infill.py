"""Fill-in-the-middle rearrangement by DuckDB inside mapInArrow.

Each Arrow batch is registered with an in-process DuckDB as a table; one SQL statement cuts its texts into units
(``regexp_extract_all``), draws from ``sha256`` of seed and doc_id, takes prefix, middle and suffix as slices of
the units (``list_slice``), joins them (``array_to_string``) and orders them by form. The result leaves as Arrow;
no row passes through Python. A unit is a run of ASCII white space with the run of other characters behind it, or
white space at the end, so the units together are the text.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` the text itself.
No marker overlaps itself or another, and texts that hold one stay plain, so the first marker of each kind in an
output is the one put there and ``restored`` rebuilds the text from output and form alone.

Defined cases: null and empty texts are plain with 0 units; a null doc_id draws from the seed alone; repeated rows
come out alike, a row each; an empty table gives no rows; extra columns are ignored. A DuckDB holds one slice of
about 4 MB of text at a time (one row at least, so a very long text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import give_back, held, slices

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def cut_sql(source: str, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> str:
    """SQL for doc_id, n, form, output, prefix_chars and middle_chars of ``source``'s doc_id and text."""
    number = "CAST('0x' || substr(h, {}, 8) AS BIGINT)".format
    return f"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{int(seed)}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '{UNIT}') AS parts FROM {source}
), drawn AS (
    SELECT *, len(parts) AS n, {number(1)} % (len(parts) + 1) AS a, {number(9)} % (len(parts) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(17)} % 100 >= {int(fim_percent)} THEN 'plain'
                WHEN {number(25)} % 100 < {int(spm_percent)} THEN 'spm' ELSE 'psm' END AS form FROM units
), cut AS (
    SELECT *, array_to_string(list_slice(parts, 1, least(a, b)), '') AS prefix, array_to_string(list_slice(parts, least(a, b) + 1, greatest(a, b)), '') AS middle,
           array_to_string(list_slice(parts, greatest(a, b) + 1, n), '') AS suffix FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars
FROM cut"""


def restored_sql(source: str) -> str:
    """SQL for every column of ``source`` and ``restored``, the text rebuilt from its output and form."""
    p, s, m = (f"instr(output, '<{mark}>')" for mark in "PSM")
    middle = f"substr(output, {m} + 3)"
    psm = f"substr(output, 4, {s} - 4) || {middle} || substr(output, {s} + 3, {m} - {s} - 3)"
    spm = f"substr(output, {p} + 3, {m} - {p} - 3) || {middle} || substr(output, 4, {p} - 4)"
    return f"SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {psm} ELSE {spm} END AS restored FROM {source}"


def digest_sql(source: str, **options: int) -> str:
    """SQL for the digests of the outputs and of the texts rebuilt from them."""
    return f"""
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM ({restored_sql(f"({cut_sql(source, **options)})")})"""


def _connect():  # noqa: ANN202
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def _by_duckdb(rows: DataFrame, sql: str, schema: str, text: str) -> DataFrame:
    """``sql`` over each slice of ``rows``, which it calls ``batch``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = held("duckdb", "infill", _connect)
        for part in slices(batches, text):
            connection.register("batch", pa.Table.from_batches([part]))
            found = connection.execute(sql).to_arrow_table().cast(wanted)
            connection.unregister("batch")
            yield from found.to_batches()
            del found
            give_back()

    return rows.mapInArrow(run, schema)


CUT = "doc_id bigint, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rearranged(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """A row per document: doc_id, n (units), form, output (the text to train on), prefix_chars, middle_chars."""
    return _by_duckdb(_rows(docs), cut_sql("batch", seed, fim_percent, spm_percent), CUT, "text")


def restored(outputs: DataFrame) -> DataFrame:
    """doc_id and text of each row of ``rearranged``."""
    rows = outputs.select("doc_id", "form", "output")
    return _by_duckdb(rows, f"SELECT doc_id, restored AS text FROM ({restored_sql('batch')})", "doc_id bigint, text string", "output")


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """As ``rearranged``, with SHA-256 of output and of the text rebuilt from it in place of the output."""
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return _by_duckdb(_rows(docs), digest_sql("batch", **options), schema, "text")
