"""Fill-in-the-middle: a text's prefix, middle and suffix are marked by sentinels
and moved, so that a model learns to write the middle.

Where a text may be cut is a Roaring-style set of byte offsets (``boundary_set``);
two hashed ranks among its members give the cuts. Python returns the number of units
and the two cuts of each text; slicing, joining, hashing and restoring are column
expressions. Each row is worked on alone, so there is no shuffle, and a lost task is
simply run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm.boundary_set import boundaries
from certlens.llm.shared import free_name
from certlens.llm.words import buffers

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 90
SPM_RATE = 20
SEED = 1
CUTS = "struct<units:long,prefix_units:long,middle_units:long,from_byte:long,to_byte:long>"


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four 32-bit draws for a document, from the SHA-256 of ``seed:doc_id``."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _cutter(unit: str):
    """Texts and two draws -> units, units of prefix and middle, both cuts in bytes."""

    @F.arrow_udf(CUTS)
    def cut(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        data, offsets = buffers(text)
        first, second = one.to_numpy(), two.to_numpy()
        out = np.zeros((5, len(text)), np.int64)
        for i in range(len(text)):
            allowed = boundaries(data[offsets[i] : offsets[i + 1]], unit)
            n = len(allowed)
            a, b = sorted((int(first[i]) % n, int(second[i]) % n))
            out[:, i] = n - 1, a, b - a, allowed.select(a), allowed.select(b)
        names = ["units", "prefix_units", "middle_units", "from_byte", "to_byte"]
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=names)

    return cut


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "char", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` plus units, form, prefix_units, middle_units and output.

    ``rate`` of 100 documents are moved, of those ``spm_rate`` of 100 with the suffix
    first (form spm, else psm); empty texts and those that hold a sentinel stay as
    they are (form plain, cuts null). A null text counts as empty, a null doc_id as an
    empty string; rows that agree in doc_id and text agree in the result. A text of
    one unit has an empty prefix, middle or suffix, which is allowed. Very long texts
    are handled whole; an empty table gives an empty result. New column names that
    ``docs`` has already get an underscore at the end."""
    body, h, cut = (free_name(docs, x) for x in ("body", "draws", "cut"))
    units, form, before, middle, output = (free_name(docs, x) for x in ("units", "form", "prefix_units", "middle_units", "output"))
    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(h, draws(F.col(doc_id), seed))
    rows = rows.withColumn(cut, _cutter(unit)(F.col(body), F.col(h)[0], F.col(h)[1]))
    held = F.col(body).contains(PREFIX) | F.col(body).contains(SUFFIX) | F.col(body).contains(MIDDLE)
    kind = F.when((F.length(body) == 0) | held | (F.col(h)[2] % 100 >= rate), "plain").when(F.col(h)[3] % 100 < spm_rate, "spm").otherwise("psm")
    a, b = F.col(cut).from_byte.cast("int"), F.col(cut).to_byte.cast("int")
    raw = F.encode(F.col(body), "UTF-8")

    def piece(start: Column | int, size: Column) -> Column:
        return F.decode(F.substring(raw, F.lit(start) + 1, size), "UTF-8")

    p, m, s = piece(0, a), piece(a, b - a), piece(b, F.octet_length(body) - b)
    rows = rows.withColumn(form, kind)
    moved = F.col(form) != "plain"
    made = (F.when(F.col(form) == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
            .when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)).otherwise(F.col(body)))
    return rows.select(*docs.columns, F.col(cut).units.alias(units), F.col(form), F.when(moved, F.col(cut).prefix_units).alias(before),
                       F.when(moved, F.col(cut).middle_units).alias(middle), made.alias(output))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No sentinel lies in a moved text, and
    none can arise where two pieces meet, so the three marks cut it exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
            .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output))


def digests(made: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)
    of ``transform``'s rows."""
    return made.select("doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
