"""Mixing sources to target weights by Pfair scheduling.

The documents of each source are dealt into blocks; the j-th block of a source of weight w may not start before slot floor((j - 1) / w) and must be placed by slot ceil(j / w). Earliest deadline first among the released blocks keeps every source within less than one block of its share at any time. With whole-number weights the schedule repeats after as many slots as they sum to, so that one period for each set of sources still at hand says where every block goes. Rational weights are made whole by their common denominator, so that no weight is rounded.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.shared_tables import named, written

#: Documents in a block, and hexadecimal digits of the parts that each source's documents are counted in.
BLOCK, DIGITS = 64, 3
#: Sources up to which the schedule, at most this many periods and one for each source, goes to every task.
FEW_SOURCES = 128
#: The largest whole weight: finer ones are refused, as their period has too many slots.
MOST_SLOTS = 1 << 13


def _whole(weights: dict[str, float | Fraction]) -> tuple[dict[str, int], int]:
    """The weights as whole numbers in the same proportions, and that of sources not named."""
    exact = {name: Fraction(str(w)) for name, w in weights.items()}  # floats are what they are written as
    unit = math.lcm(*(w.denominator for w in exact.values()))
    shares = {name: int(w * unit) for name, w in exact.items()}
    common = math.gcd(unit, *shares.values())
    if max(unit, *shares.values(), 0) // common > MOST_SLOTS:
        raise ValueError(f"target weights must be multiples of a unit of which none has over {MOST_SLOTS}; give fractions such as Fraction(1, 3), or a resolution to round to")
    return {name: a // common for name, a in shares.items()}, unit // common


def _weight(source: Column, weights: dict[str, float | Fraction], exact: bool) -> Column:
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be over 0")
    named, other = _whole(weights) if exact else ({name: float(w) for name, w in weights.items()}, 1.0)
    out = F.lit(other)
    for name, w in sorted(named.items()):
        out = F.when(source == name, w).otherwise(out)
    return out


def _period(sources: Column, size: Column) -> Column:
    """Earliest deadline first over one period: an array of (index of the source, which of its blocks), by slot.

    Each step counts the block that the step before has chosen, and chooses one. Slots are gathered in pieces of about the root of their number, so that none is copied more often than that.
    """
    piece = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    slot, none = "struct<i:int,nth:bigint>", "CAST(array() AS array<{}>)"

    def chosen(done: Column, t: Column) -> Column:
        def job(s: Column, n: Column) -> Column:
            ready = (n < s["a"]) & (F.floor(n * size / s["a"]) <= t)
            return F.when(ready, F.struct(F.ceil((n + 1) * size / s["a"]).alias("deadline"), s["i"].alias("i"), n.alias("nth")))

        return F.array_min(F.zip_with(F.transform(sources, lambda s, i: F.struct(s["a"].alias("a"), i.alias("i"))), done, job))

    def step(acc: Column, t: Column) -> Column:
        last = acc["best"]
        done = F.transform(acc["done"], lambda n, i: n + F.when(i == last["i"], 1).otherwise(0))
        here = F.concat(acc["here"], F.array(F.struct(last["i"].alias("i"), last["nth"].alias("nth"))))
        full = t % piece == 0
        return F.struct(done.alias("done"), chosen(done, t).alias("best"), F.when(full, F.expr(none.format(slot))).otherwise(here).alias("here"), F.when(full, F.concat(acc["before"], F.array(here))).otherwise(acc["before"]).alias("before"))

    def gathered(acc: Column) -> Column:
        last = acc["best"]
        return F.concat(F.flatten(acc["before"]), acc["here"], F.filter(F.array(F.struct(last["i"].alias("i"), last["nth"].alias("nth"))), lambda x: x["i"].isNotNull()))

    zero = F.transform(sources, lambda s: F.lit(0).cast("long"))
    start = F.struct(zero.alias("done"), chosen(zero, F.lit(0).cast("long")).alias("best"), F.expr(none.format(slot)).alias("here"), F.expr(none.format(f"array<{slot}>")).alias("before"))
    later = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), size - 1)), lambda t: t > 0)
    return F.aggregate(later, start, step, gathered)


def schedule(totals: DataFrame, block: int, resolution: int | None) -> DataFrame:
    """By source (key): its share a of a period's slots, and phases: (first period, period after the last, first slot, slots of a period, slots of its blocks).

    totals: key, weight, n; without a resolution, weights are whole numbers. A source takes part in as many periods as its blocks fill; when one runs out, the others go on with the same weights relative to each other.
    """
    blocks = F.ceil(F.col("n") / block)
    one = totals.agg(F.collect_list(F.struct("key", "weight", "n")).alias("s"), F.sum("weight").alias("weights"), F.collect_set("weight").alias("distinct"), F.min("weight").alias("least"))
    if resolution is None:
        divisors = F.filter(F.sequence(F.lit(1), F.col("least").cast("int")), lambda d: F.forall("distinct", lambda w: w % d == 0))
        one, share = one.withColumn("weights", F.array_max(divisors)), (F.col("weight") / F.col("weights")).cast("int")
    else:
        share = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("weights") * resolution).cast("int"))
    sources = one.select("weights", F.explode("s").alias("s")).select("s.*", "weights").select("key", share.alias("a"), F.ceil(blocks / share).alias("periods"))
    one = sources.agg(F.array_sort(F.collect_list(F.struct("key", "a", "periods"))).alias("all"), F.array_sort(F.collect_set("periods")).alias("ends"))
    phases = one.select("all", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))).alias("since"), F.col("ends").alias("until"))).alias("phase", "p"))
    phases = phases.select("phase", "p.since", "p.until", F.filter("all", lambda s: s["periods"] >= F.col("p.until")).alias("sources"))
    phases = phases.withColumn("size", F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + s["a"]))
    order = phases.groupBy("phase").agg(*(F.first(c).alias(c) for c in ("since", "until", "sources", "size")))  # each phase may go to another task
    order = order.withColumn("order", _period(F.col("sources"), F.col("size")))
    length = (F.col("until") - F.col("since")) * F.col("size")
    order = order.withColumn("first", F.sum(length).over(Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each phase
    slots = order.select("since", "until", "size", F.coalesce("first", F.lit(0)).alias("first"), "sources", F.posexplode("order").alias("slot", "o"))
    mine = slots.select(F.col("sources")[F.col("o.i")]["key"].alias("key"), F.col("sources")[F.col("o.i")]["a"].alias("a"), "since", "until", "first", "size", F.struct("o.nth", "slot").alias("at"))
    mine = mine.groupBy("key", "a", "since", "until", "first", "size").agg(F.array_sort(F.collect_list("at")).alias("at"))
    phase = F.struct("since", "until", "first", "size", F.transform("at", lambda x: x["slot"]).alias("slots"))
    return mine.groupBy("key", "a").agg(F.array_sort(F.collect_list(phase)).alias("phases"))


def mixed(documents: DataFrame, weights: dict[str, float | Fraction] | None = None, block: int = BLOCK, resolution: int | None = None, digits: int = DIGITS) -> DataFrame:
    """documents with three more columns: block (of the source, from 0), slot (of all; the order in which blocks are read) and place (within the block).

    documents: doc_id and source; other columns are kept, and ones named block, slot or place are replaced. weights: target weights by source, 1 for those not named. They are kept exactly, unless there is a resolution: then each is rounded to a whole number of slots of a period of about that size, at least one. Every row is placed: sources that run out leave the others their slots, so that slots near such an end may stay empty. Texts are not looked at. The order within a source is that of the md5 of doc_id's digits, and of equal deadlines the source of the least name goes first; rows of equal doc_id stand next to each other in any order; rows without a source form a source of their own; an empty table gives an empty result. Only sources, not documents, are ever gathered in one place.
    """
    own = documents.drop("block", "slot", "place")
    key, number = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = own.select(F.struct(*map(named, own.columns)).alias("own_"), "doc_id", key.alias("key_"), F.md5(number).alias("hash_")).withColumn("bucket_", F.left("hash_", F.lit(digits)))
    counts = docs.groupBy("key_", "bucket_").agg(F.count("*").alias("n_"))
    counts = written(counts)
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("key_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("key_").alias("k_"), F.col("bucket_").alias("b_"), before.alias("before_"))
    totals = counts.groupBy(F.col("key_").alias("key")).agg(F.sum("n_").alias("n")).withColumn("weight", _weight(F.expr("substring(key, 2)"), weights or {}, resolution is None))
    plan = written(schedule(totals, block, resolution))
    ranked = docs.withColumn("rank_", F.row_number().over(Window.partitionBy("key_", "bucket_").orderBy("hash_", "doc_id")) - 1)
    at = ranked.join(starts, (F.col("key_") == F.col("k_")) & (F.col("bucket_") == F.col("b_"))).withColumn("at_", F.col("before_") + F.col("rank_"))
    at = at.withColumn("block", F.expr(f"at_ div {block}")).withColumn("place", F.col("at_") % block)
    small = plan.count() <= FEW_SOURCES
    at = at.join(F.broadcast(plan) if small else plan, F.col("key_") == F.col("key"))
    period = F.expr("block div a")
    phase = F.filter("phases", lambda p: p["until"] > period)[0]
    slot = phase["first"] + (period - phase["since"]) * phase["size"] + F.get(phase["slots"], (F.col("block") % F.col("a")).cast("int"))
    return at.withColumn("slot", slot).select("own_.*", "block", "slot", "place")
