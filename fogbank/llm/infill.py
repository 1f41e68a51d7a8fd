"""Fill-in-middle transformation (operator 11): DuckDB inside mapInArrow.

A text is cut into tokens (a word with the white space before it, or white space at the end), two of the token borders
are drawn from a hash of the document's id, and the three parts between them are put in the order in which a model that
fills in the middle reads them: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its mark. Texts
that aren't drawn, are empty or contain a mark stay as they are (plain).

Each Arrow batch is registered as a table of an in-memory DuckDB that lives as long as the task, and one SQL statement
cuts, draws and joins it; no value of it becomes a Python object. A batch is passed on in lots of at most ``lot_bytes`` of text
(or one longer text), so that the tokens that DuckDB holds are bounded by the longest text and not by the batch. There is
no shuffle, and rows stay in their partitions.

Null text is empty; a null id is drawn as an empty one; repeated rows stay repeated; an empty table gives no rows; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = "42"
#: Of 100 texts so many are transformed, and of 100 of those so many are spm.
SHARE, SPM_SHARE = 50, 80
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
LOT_BYTES = 8 << 20


def transformation(seed: str, share: int, spm_share: int, marks: tuple[str, str, str]) -> str:
    """The SQL over a table ``lot`` (id, key, text): doc_id, n, form, prefix_chars, middle_chars, output."""
    p, s, m = ("'" + x.replace("'", "''") + "'" for x in marks)
    head = "'" + seed.replace("'", "''") + ":'"
    draw = lambda i: f"('0x' || substr(digest, {8 * i + 1}, 8))::UBIGINT"
    part = lambda a, b: f"array_to_string(list_slice(tokens, {a}, {b}), '')"
    return f"""
    WITH cut AS (SELECT id, text, regexp_extract_all(text, '{TOKEN}') AS tokens, sha256({head} || key) AS digest FROM lot),
    drawn AS (
      SELECT id, text, tokens, len(tokens) AS n, {draw(0)} % (len(tokens) + 1) AS one, {draw(1)} % (len(tokens) + 1) AS other,
        CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {int(share)} THEN 'plain'
             WHEN {draw(3)} % 100 < {int(spm_share)} THEN 'spm' ELSE 'psm' END AS form
      FROM cut),
    parts AS (
      SELECT id, text, n, form,
        CASE WHEN form <> 'plain' THEN {part(1, "least(one, other)::BIGINT")} END AS prefix,
        CASE WHEN form <> 'plain' THEN {part("least(one, other)::BIGINT + 1", "greatest(one, other)::BIGINT")} END AS middle,
        CASE WHEN form <> 'plain' THEN {part("greatest(one, other)::BIGINT + 1", "n")} END AS suffix
      FROM drawn)
    SELECT id AS doc_id, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
      CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
                ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
    FROM parts"""


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of a column's text, or one longer row; nothing is copied."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, share: int = SHARE, spm_share: int = SPM_SHARE, marks: tuple[str, str, str] = MARKS, lot_bytes: int = LOT_BYTES
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output for each row of docs."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("the three marks must differ and not be empty")
    query = transformation(seed, share, spm_share, marks)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as base:
            for batch in batches:
                for lot in by_bytes(batch, 2, lot_bytes):
                    base.register("lot", pa.Table.from_batches([lot]))
                    yield from base.sql(query).to_arrow_table().cast(schema(batch)).to_batches()
                    base.unregister("lot")

    def schema(batch: pa.RecordBatch) -> pa.Schema:  # strings as Spark reads them, and the id as it came
        made = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
        return pa.schema([pa.field("doc_id", batch.schema.field(0).type), *made])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(transform, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a transformed one was made of, from the output and its form alone.

    A transformed text contained no mark, and none arises at a border as long as no mark overlaps another, so the
    output splits at its three marks.
    """
    parts = F.split(output, "|".join(r"\Q" + m + r"\E" for m in marks), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


#: The parts are cut by code points, as the tokens before a border are as long together as the text up to it.
OP11_SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
k AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM t),
cut AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(list_sum(list_transform(units[1:least(a, b)], lambda u: length(u))), 0)::BIGINT AS p,
    coalesce(list_sum(list_transform(units[1:greatest(a, b)], lambda u: length(u))), 0)::BIGINT AS q FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substring(text, 1, p) || '<S>' || substring(text, q + 1) || '<M>' || substring(text, p + 1, q - p)
    ELSE '<S>' || substring(text, q + 1) || '<P>' || substring(text, 1, p) || '<M>' || substring(text, p + 1, q - p) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut"""
