"""Texts rearranged so that a model learns to fill in a middle, by bit-parallel work on big integers.

A text is its UTF-8 bytes. bytes.translate turns them into a class mask, an integer with one bit for each byte; shifts and boolean operations on whole masks mark where units begin, bit_count gives their number, and halving the mask finds the byte of the k-th unit. Nothing walks over characters one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches, packed, packed_column
from attestra.llm.text_arrays import chunks

#: Fixed values of the output's form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def _table(chars: bytes) -> bytes:
    return bytes(0x31 if b in chars else 0x30 for b in range(256))


_INNER = _table(bytes(range(0x80, 0xC0)))
_WHITE = _table(b" \t\n\v\f\r")
_LINE_END = _table(b"\n")


def class_mask(text: bytes, table: bytes) -> int:
    """An integer whose bit i says whether byte i belongs to the table's class."""
    return int(text.translate(table)[::-1], 2) if text else 0


def boundaries(text: bytes, unit: str = "character") -> int:
    """Bits of the bytes at which units begin: code points, words (each with the white space after it; what comes before the first belongs to it) or lines."""
    whole = (1 << len(text)) - 1
    if unit == "character":
        return whole ^ class_mask(text, _INNER)
    if unit == "word":
        white = class_mask(text, _WHITE)
        return (whole ^ white) & ((white << 1) | 1)
    if unit == "line":
        return ((class_mask(text, _LINE_END) << 1) | 1) & whole
    raise ValueError(f"unknown unit {unit!r}")


def ranked(mask: int, k: int, width: int) -> int:
    """The place of the set bit that has k set bits below it, among the lowest `width` bits: halves are counted until 64 bits are left."""
    at = 0
    while width > 64:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            mask, width = low, half
        else:
            mask, width, k, at = mask >> half, width - half, k - below, at + half
    for _ in range(k):
        mask &= mask - 1
    return at + (mask & -mask).bit_length() - 1


def cut(text: bytes, mask: int, n: int, k: int) -> int:
    """The byte at which unit k begins; the first begins at 0, and after the last comes the end."""
    return 0 if k == 0 else len(text) if k >= n else ranked(mask, k, len(text))


def rearranged(text: bytes, key: bytes, unit: str, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, units of the prefix and of the middle, and the output. The first four 8-digit groups of the key's hex sha256 choose the cuts and the form."""
    mask = boundaries(text, unit)
    n = mask.bit_count()
    h = hashlib.sha256(key).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))
    if n == 0 or h3 % 100 >= plain_from or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut(text, mask, n, first), cut(text, mask, n, second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(documents: DataFrame, seed: int = 1, unit: str = "character", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """documents without text, and n (units), form (plain, psm or spm), prefix_chars and middle_chars (units; null if plain) and output, the text as it is learnt from.

    Which texts stay plain and where the others are cut follows from seed and doc_id alone, so rows of equal doc_id and text get equal outputs. A null text counts as empty; empty texts, texts without a unit and texts that contain a mark of the form stay plain. A null doc_id counts as an empty one. Texts are taken whole, however long; a batch holds about 4 MB or one text. Other columns stay; those named like the new ones are replaced.
    """
    bounded_batches(documents.sparkSession)
    frame = packed(documents).withColumn("key", F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    kinds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    schema = frame.select("doc_id", "rest__").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                own = batch.slice(chunk.first, chunk.n)
                made = [rearranged(chunk.text(i), key.encode(), unit, plain_from, spm_below) for i, key in enumerate(own.column("key").to_pylist())]
                columns = [pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                columns[4] = columns[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("rest__"), *columns], names=["doc_id", "rest__", *kinds])

    done = frame.mapInArrow(run, schema)
    kept = [c for c in documents.columns if c != "text" and c not in _NEW]
    return done.select(*(packed_column(documents.columns, c).alias(c) for c in kept), *_NEW)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts, cut at the marks and put back in order."""
    part = F.split(output, "<[PSM]>")
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digest(rearranged: DataFrame) -> DataFrame:
    """What the query reports of fill_in_middle: counts, and digests of the outputs and of the texts rebuilt from them."""
    return rearranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
