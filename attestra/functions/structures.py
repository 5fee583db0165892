"""Functions on arrays: word alignment, common beginnings, slices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """The words two lists begin with alike."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.slice(a, F.lit(1), F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int"))


def common_prefix_of(lists: Column) -> Column:
    """The words that all lists begin with; none without lists."""
    rest = F.slice(lists, F.lit(2), F.greatest(F.size(lists) - 1, F.lit(0)))
    return F.when(F.size(lists) == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.aggregate(rest, F.get(lists, F.lit(0)), common_prefix))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance, row by row of the usual table."""

    def row(above: Column, r: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            h, diagonal, up, left = F.get(hyp, j), F.get(above, j), F.get(above, j + 1), F.get(done, j)
            return F.concat(done, F.array(F.least(up + 1, left + 1, diagonal + F.when(h == r, 0).otherwise(1))))

        return F.when(F.size(hyp) == 0, F.array(above[0] + 1)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(hyp) - 1), F.array(above[0] + 1), cell))

    start = F.sequence(F.lit(0), F.size(hyp))
    return F.aggregate(ref, start, row, lambda last: F.element_at(last, -1))


def error_rate(distance: Column, ref: Column, hyp: Column) -> Column:
    """Distance over the reference's words; without any, 0 if nothing was heard and 1 otherwise."""
    return F.when(F.size(ref) > 0, distance / F.size(ref)).otherwise(F.when(F.size(hyp) == 0, 0.0).otherwise(1.0))


#: Cells of an alignment's table up to which all of it is kept.
WHOLE = 1 << 20


def _aligned(ref: list[str], hyp: list[str]) -> tuple[int, int, int, list[dict]]:
    n, m = len(ref), len(hyp)
    number = {w: k for k, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([number[w] for w in hyp], np.int64)
    steps = np.arange(m + 1, dtype=np.int32)

    def below(above: np.ndarray, i: int) -> np.ndarray:
        row = np.empty_like(steps)
        row[0] = i
        np.minimum(above[1:] + 1, above[:-1] + (h != number[ref[i - 1]]), out=row[1:])
        row -= steps
        np.minimum.accumulate(row, out=row)
        row += steps
        return row

    # small tables are kept whole; of others every size-th row, and on the way back the rows between two of them are made again
    size = max(n, 1) if n * m <= WHOLE else math.isqrt(n) + 1
    row, kept = steps, {0: steps}
    for i in range(1, n + 1 if size < n else 1):
        row = below(row, i)
        if i % size == 0:
            kept[i] = row
    base, block = -1, []
    counts, pairs = [0, 0, 0], []
    while n or m:
        if n and (n - 1) // size * size != base:
            base = (n - 1) // size * size
            block = [kept[base]]
            for i in range(base + 1, min(base + size, n) + 1):
                block.append(below(block[-1], i))
        here = block[n - base][m] if n else m
        above = block[n - 1 - base] if n else None
        if n and m and ref[n - 1] == hyp[m - 1] and here == above[m - 1]:
            n, m = n - 1, m - 1
        elif n and m and here == above[m - 1] + 1:
            pairs.append({"ref": ref[n - 1], "hyp": hyp[m - 1]})
            counts[0] += 1
            n, m = n - 1, m - 1
        elif n and here == above[m] + 1:
            counts[1] += 1
            n -= 1
        else:
            counts[2] += 1
            m -= 1
    return *counts, pairs[::-1]


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("ref", pa.string()), ("hyp", pa.string())]))
    for batch in batches:
        found = [_aligned(r or [], h or []) for r, h in zip(batch.column("ref_words").to_pylist(), batch.column("hyp_words").to_pylist(), strict=True)]
        sub, gone, ins, pairs = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sub, pa.int64()), pa.array(gone, pa.int64()), pa.array(ins, pa.int64()), pa.array(pairs, pair)], names=[*batch.schema.names, "sub", "del", "ins", "subs"])


def with_alignment(pairs: DataFrame) -> DataFrame:
    """pairs (ref_words, hyp_words and others) with sub, del, ins and subs, the substituted words in order; a way back through the table that prefers matches, then substitutions, then deletions."""
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pairs.schema)
    return pairs.mapInArrow(_align_batches, f"{kinds}, sub long, del long, ins long, subs array<struct<ref:string,hyp:string>>")


def slices(c: Column, size: int) -> Column:
    """A binary or string value cut into pieces of at most that length; an empty one is one piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda o: F.substring(c, o + 1, F.lit(size)))
