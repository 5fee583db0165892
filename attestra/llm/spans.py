"""Spans found in texts: in code points, named by kind, as rows and as joined strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.llm.text_arrays import Chunk

SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
SPAN_SQL = "array<struct<start:long,rank:int,kind:string,end:long>>"


def runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Maximal runs of set flags of at least that length, cut at the documents' bounds: rows of (begin, end)."""
    edge = np.zeros(len(flags) + 1, np.int8)
    edge[:-1] += flags
    edge[1:] -= flags
    begins, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flags))]
    cut = np.unique(inner[flags[inner] & flags[inner - 1]]) if len(inner) else inner
    begins, ends = np.sort(np.concatenate([begins, cut])), np.sort(np.concatenate([ends, cut]))
    keep = ends - begins >= least
    return np.column_stack([begins[keep], ends[keep]])


def document_of(chunk: Chunk, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(chunk.offsets, at, "right") - 1


def code_points(text: bytes) -> np.ndarray | None:
    """By byte position the code points before it; None where the two are the same."""
    if text.isascii():
        return None
    data = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind in its fixed order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(kind: str) -> Column:
    """How many of the column spans are of that kind."""
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
