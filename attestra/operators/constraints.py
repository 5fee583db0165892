"""What a table declares about its rows, checked by group in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    """required: columns without nulls; unique: lists of columns of which no two rows are alike; dense: lists of columns of whose values each combination is there.

    approximate: distinct rows are counted by HyperLogLog sketches, which merge and stay small; a count then is a fault only where it is off by more than three times a sketch's error. Exact counts hold a group's distinct values while they are counted.
    """

    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    dense: tuple[tuple[str, ...], ...] = ()
    approximate: bool = False
    log_size: int = 14

    def tolerance(self) -> float:
        """The share by which a sketch of 2^log_size buckets may be off, three times over."""
        return 3 * 1.04 / 2 ** (self.log_size / 2) if self.approximate else 0.0


def _distinct(columns: tuple[str, ...], c: Constraints) -> Column:
    value = F.struct(*columns)
    if not c.approximate:
        return F.count_distinct(value)
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256), c.log_size))


def violations(rows: DataFrame, by: list[str], c: Constraints) -> DataFrame:
    """by, problem and n: rows without a required value, rows beyond the first of a unique key, combinations that a dense grid lacks (or has too many of, below 0, by an estimate). Groups that keep what is declared have no row, and so have those that aren't there."""
    wanted = {("count",): F.count("*")}
    for columns in c.unique:
        wanted[columns] = _distinct(columns, c)
    for columns in c.dense:
        wanted |= {x: _distinct(x, c) for x in (columns, *((y,) for y in columns))}
    named = {columns: f"n{k}__" for k, columns in enumerate(wanted)}
    counted = rows.groupBy(*by).agg(*(F.count_if(F.col(x).isNull()).alias(f"null{k}__") for k, x in enumerate(c.required)), *(of.alias(named[columns]) for columns, of in wanted.items()))
    total, n = F.col(named[("count",)]), lambda columns: F.col(named[columns])
    told = [(f"no {x}", F.col(f"null{k}__"), F.lit(0.0)) for k, x in enumerate(c.required)]
    told += [(f"not unique: {', '.join(x)}", total - n(x), total * c.tolerance()) for x in c.unique]
    for columns in c.dense:
        grid = F.lit(1)
        for x in columns:
            grid = grid * n((x,))
        told.append((f"not dense: {', '.join(columns)}", grid - n(columns), grid * c.tolerance() * len(columns)))
    found = F.filter(F.array(*(F.when(F.abs(off) > slack, F.struct(F.lit(name).alias("problem"), off.cast("long").alias("n"))) for name, off, slack in told)), lambda x: x.isNotNull())
    return counted.select(*by, F.explode(found).alias("p")).select(*by, "p.*")
