"""Extracted values against annotated truth: one verdict for each record and field, and what they add up to.

cells: slug, path, kind (number, string or enum), is_health, is_band, truth, value, source_span, alternatives (array), retracted (array), acceptable_miss, text. Values are strings in their canonical form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.numbers import near
from attestra.functions.strings import same_value, span_class

#: Verdicts by bucket, and the order in which claims on a cell win.
BUCKETS = {
    "correct": "captured", "sanctioned": "captured", "health-correct": "captured", "correct-null": "absent", "health-correct-null": "absent",
    "miss": "short", "health-miss": "short", "excused": "excused", "soft": "excused", "silent-not-tested": "excused",
    "hallucination": "fault", "health-hallucinated-pass": "fault", "health-hallucinated-problem": "fault", "wrong": "fault", "retracted": "fault", "health-wrong-state": "fault", "unscorable": "short",
}
HAZARDS = ("hallucination", "health-hallucinated-pass", "health-hallucinated-problem", "health-wrong-state", "wrong", "retracted", "unscorable")


def spine(slugs: DataFrame, paths: list) -> DataFrame:
    """Every slug with every path of a fixed inventory."""
    return slugs.select("slug", F.explode(F.array(*map(F.lit, paths))).alias("path"))


def grid(slugs: DataFrame, paths: list[str], truth: DataFrame, model: DataFrame) -> DataFrame:
    """Every slug with every path, and what truth and model (slug, path, ...) say of it; without a model's row all is null."""
    return spine(slugs, paths).join(truth, ["slug", "path"], "left").join(model, ["slug", "path"], "left")


def resolved_members(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """values (path, value, ...) with member: the literal, else the name, of the path's vocabulary (path, member, name) that it equals."""
    literal = vocabulary.select("path", F.col("member").alias("value"), F.col("member").alias("by_literal"))
    name = vocabulary.select("path", F.col("name").alias("value"), F.col("member").alias("by_name"))
    joined = values.join(literal, ["path", "value"], "left").join(name, ["path", "value"], "left")
    return joined.withColumn("member", F.coalesce("by_literal", "by_name")).drop("by_literal", "by_name")


def overlaid(cells: DataFrame, disclaimers: DataFrame, explicit: DataFrame) -> DataFrame:
    """The status of every one of the cells (slug, path): what is said of it, else that it was declared absent, else unmentioned."""
    said, absent = explicit.select("slug", "path", F.col("status").alias("said")), disclaimers.select("slug", "path", F.lit("declared_absent").alias("absent")).distinct()
    return cells.join(absent, ["slug", "path"], "left").join(said, ["slug", "path"], "left").select(*cells.columns, F.coalesce("said", "absent", F.lit("unmentioned")).alias("status"))


def equal_values(kind: Column, a: Column, b: Column) -> Column:
    numbers = F.coalesce(near(a.try_cast("double"), b.try_cast("double")), F.lit(False))
    return F.when(kind == "number", numbers).when(kind == "string", same_value(a, b)).otherwise(a == b)


def verdict(cells: DataFrame) -> DataFrame:
    """cells with verdict, bucket and span_issue (null, missing, near-miss or fabricated)."""
    g, m, health, kind = F.col("truth"), F.col("value"), F.col("is_health"), F.col("kind")
    right = equal_values(kind, g, m)
    listed = F.coalesce(F.exists("alternatives", lambda x: equal_values(kind, x, m)), F.lit(False))
    taken_back = F.coalesce(F.exists("retracted", lambda x: equal_values(kind, x, m)), F.lit(False))
    unscorable = (kind == "number") & m.try_cast("double").isNull()
    nothing_true = (
        F.when(m.isNull() & health, "health-correct-null").when(m.isNull(), "correct-null").when(listed, "soft").when(health & (m == "Not Tested"), "silent-not-tested")
        .when(health & (m == "Passed"), "health-hallucinated-pass").when(health, "health-hallucinated-problem").otherwise("hallucination")
    )
    nothing_said = F.when(F.coalesce("acceptable_miss", F.lit(False)), "excused").when(health, "health-miss").otherwise("miss")
    both = (
        F.when(unscorable & ~listed, "unscorable").when(~right & listed, "sanctioned").when(health & right, "health-correct").when(health & (m == "Passed"), "health-hallucinated-pass")
        .when(health, "health-wrong-state").when(taken_back, "retracted").when(right, "correct").otherwise("wrong")
    )
    found = F.when(g.isNull(), nothing_true).when(m.isNull(), nothing_said).otherwise(both)
    span = F.when(m.isNull() & F.col("source_span").isNull(), None).when(F.col("source_span").isNull(), "missing").otherwise(F.nullif(span_class(F.col("source_span"), F.col("text")), F.lit("verbatim")))
    buckets = F.create_map(*(F.lit(x) for pair in BUCKETS.items() for x in pair))
    return cells.withColumn("verdict", found).withColumn("bucket", buckets[F.col("verdict")]).withColumn("span_issue", span)


def _n(*verdicts: str) -> Column:
    return F.count_if(F.col("verdict").isin(*verdicts))


def totals(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters and rates of judged cells, over all or by columns; a rate without a denominator is null. Rates are ratios of sums."""
    generic, health = ~F.col("is_health"), F.col("is_health")
    there = F.col("truth").isNotNull()
    counted = judged.groupBy(*(by or [])).agg(
        F.count_if(generic & ~there).alias("gt_null"), F.count_if(generic & there).alias("gt_non_null"), F.count_if(health & ~there).alias("h_gt_null"), F.count_if(health & there).alias("h_gt_state"),
        _n("correct-null", "health-correct-null").alias("correct_null"), F.count_if(there & F.col("value").isNotNull()).alias("both_non_null"),
        _n("hallucination").alias("hallucination_hard"), _n("soft").alias("hallucination_soft"), F.count_if(generic & (F.col("verdict") == "excused")).alias("miss_excused"), _n("miss").alias("miss"),
        F.count_if((F.col("verdict") == "miss") & (F.col("kind") == "enum")).alias("enum_miss"), F.count_if((F.col("verdict") == "miss") & F.col("is_band")).alias("band_miss"),
        _n("correct").alias("correct"), _n("wrong").alias("wrong"), _n("retracted").alias("retracted"), _n("sanctioned").alias("sanctioned"), _n("unscorable").alias("unscorable"),
        _n("health-miss").alias("h_miss"), F.count_if((F.col("verdict") == "health-miss") & (F.col("truth") == "Passed")).alias("h_clean_dropped"), F.count_if(health & (F.col("verdict") == "excused")).alias("h_miss_excused"),
        _n("health-correct").alias("h_correct"), _n("health-wrong-state").alias("h_wrong_state"), _n("health-hallucinated-pass").alias("h_hallucinated_pass"), _n("health-hallucinated-problem").alias("h_hallucinated_problem"), _n("silent-not-tested").alias("h_silent"),
        F.count_if(F.col("span_issue") == "missing").alias("span_missing"), F.count_if(F.col("span_issue") == "near-miss").alias("span_near_miss"), F.count_if(F.col("span_issue") == "fabricated").alias("span_fabricated"),
    )
    rate = lambda n, d: F.try_divide(n, d)
    c = F.col
    return counted.select(
        "*",
        rate(c("hallucination_hard"), c("gt_null")).alias("hallucination_rate"),
        rate(c("miss"), c("gt_non_null") - c("miss_excused")).alias("miss_rate"),
        rate(c("miss") + c("h_miss"), c("gt_non_null") - c("miss_excused") + c("h_gt_state") - c("h_miss_excused")).alias("all_miss_rate"),
        rate(c("h_correct"), c("h_correct") + c("h_wrong_state")).alias("health_accuracy"),
    )


def gate(judged: DataFrame, by: list[str]) -> DataFrame:
    """By columns: whether no hazard is among the cells, and each hazard's count."""
    return judged.groupBy(*by).agg(F.bool_and(~F.col("verdict").isin(*HAZARDS)).alias("passed"), *(_n(h).alias(h.replace("-", "_")) for h in HAZARDS))


def first_claims(claims: DataFrame, order: dict[str, int]) -> DataFrame:
    """Of several verdicts on a cell the one that comes first in the given order, which is small."""
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    return claims.groupBy("slug", "path").agg(F.min_by("verdict", rank[F.col("verdict")]).alias("verdict"))


def dense(judged: DataFrame, slugs: list[str]) -> DataFrame:
    """A row for each path, a column for each of the given slugs."""
    return judged.groupBy("path").pivot("slug", slugs).agg(F.first("verdict"))


def problems(judged: DataFrame, limit: int | None = None) -> DataFrame:
    """Cells that are neither captured nor absent, numbered by rank of bucket, path and slug; the report names them p-01 and so on."""
    rank = F.when(F.col("bucket") == "fault", 0).when(F.col("bucket") == "short", 1).otherwise(2)
    found = judged.where(~F.col("bucket").isin("captured", "absent")).withColumn("rank", rank).orderBy("rank", "path", "slug")
    return found if limit is None else found.limit(limit)


def flags_by_slug(judged: DataFrame, hot: int = 4) -> DataFrame:
    """Faults of each slug; hot marks the one with most, if those are `hot` at least (the first by name on a tie)."""
    counts = judged.groupBy("slug").agg(F.count_if(F.col("bucket") == "fault").alias("n_flags"))
    top = counts.groupBy().agg(F.min_by("slug", F.struct(-F.col("n_flags"), F.col("slug"))).alias("top")).scalar()
    return counts.select("slug", "n_flags", ((F.col("slug") == top) & (F.col("n_flags") >= hot)).alias("hot"))


def confidence_gap(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean confidence of right and of wrong cells, and their difference; null where there are none."""
    right, wrong = F.col("verdict").isin("correct", "health-correct"), F.col("verdict").isin("wrong", "retracted", "hallucination", "health-wrong-state")
    means = judged.groupBy(*(by or [])).agg(F.avg(F.when(right, F.col("confidence"))).alias("right_confidence"), F.avg(F.when(wrong, F.col("confidence"))).alias("wrong_confidence"))
    return means.withColumn("gap", F.col("right_confidence") - F.col("wrong_confidence"))


def compared(base: DataFrame, other: DataFrame) -> DataFrame:
    """Cells whose value only one of two runs (slug, path, value) has, or in which they differ."""
    joined = base.select("slug", "path", F.col("value").alias("was")).join(other.select("slug", "path", F.col("value").alias("now")), ["slug", "path"], "full")
    change = F.when(F.col("was").isNull() & F.col("now").isNull(), "none").when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("none")
    return joined.withColumn("change", change).where("change != 'none'")


def axis_category(equipment_truth: Column, equipment: Column, fuel_truth: Column, fuel: Column) -> Column:
    """What became of a pair of fields that belong together."""
    e, f = F.coalesce(equipment == equipment_truth, F.lit(False)), F.coalesce(fuel == fuel_truth, F.lit(False))
    return (F.when(equipment_truth.isNull() | fuel_truth.isNull(), "not-stated").when(e & f, "both").when(e & fuel.isNull(), "second-dropped").when(f & equipment.isNull(), "first-dropped")
            .when(equipment.isNull() & fuel.isNull(), "both-dropped").when(e, "second-wrong").when(f, "first-wrong").otherwise("both-wrong"))


def history_line(runs: DataFrame, value: str, order: str = "captured_at") -> DataFrame:
    """By label the least, greatest and last value of its runs."""
    return runs.groupBy("label").agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))


def enum_tag(options: Column, truth: Column, value: Column) -> Column:
    """How far a value is from a true member of an ordered vocabulary: invalid (none of it), boundary (its neighbour), or null."""
    x, y = F.array_position(options, truth), F.array_position(options, value)
    return F.when(y == 0, "invalid").when(F.abs(x - y) == 1, "boundary")


def counters(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All 43 counters of judged cells that also have options (an enum's or band's members in order), by_name (the value is a member's name, not the member) and converted (a value that may not be made from what the text says)."""
    generic, health, v = ~F.col("is_health"), F.col("is_health"), F.col("verdict")
    there, said = F.col("truth").isNotNull(), F.col("value").isNotNull()
    scored = judged.withColumn("tag__", F.when(F.col("kind") == "enum", enum_tag(F.col("options"), F.col("truth"), F.col("value"))))
    compared = generic & v.isin("correct", "wrong", "retracted")
    enum, band, right, tag = compared & (F.col("kind") == "enum"), compared & F.col("is_band"), v == "correct", F.coalesce("tag__", F.lit(""))
    passed, member = F.col("truth") == "Passed", v.isin("correct", "health-correct") & (F.col("kind") == "enum")
    span = F.col("span_issue")
    n = F.count_if
    return scored.groupBy(*(by or [])).agg(
        n(generic & ~there).alias("gt_null"), n(generic & there).alias("gt_non_null"), n(~there & ~said).alias("correct_null"), _n("hallucination").alias("hallucination_hard"), _n("soft").alias("hallucination_soft"),
        _n("unscorable").alias("unscorable"), _n("miss").alias("miss"), n(generic & (v == "excused")).alias("miss_excused"), n(there & said).alias("both_non_null"), n(generic & right).alias("correct"), _n("wrong", "retracted").alias("wrong"),
        n(~there & said & F.col("converted")).alias("rvalue_conversion"), n(enum).alias("enum_gt_member"), n(enum & right).alias("enum_correct"), n(enum & ~right & ~tag.isin("invalid", "boundary")).alias("enum_wrong_member"), n(enum & ~right & (tag == "invalid")).alias("enum_invalid"),
        n((v == "miss") & (F.col("kind") == "enum")).alias("enum_miss"), _n("sanctioned").alias("enum_sanctioned"), n(member & ~F.col("by_name")).alias("vocab_api"), n(member & F.col("by_name")).alias("vocab_slug"),
        n(band).alias("band_gt"), n(band & right).alias("band_correct"), n(band & ~right & (tag == "boundary")).alias("band_boundary"), n(band & ~right & (tag != "boundary")).alias("band_wrong"), n((v == "miss") & F.col("is_band")).alias("band_miss"),
        n(said).alias("span_checked"), n(said & span.isNull()).alias("span_verbatim"), n(said & (span == "near-miss")).alias("span_near_miss"), n(said & (span == "fabricated")).alias("span_fabricated"), n(said & (span == "missing")).alias("span_missing"),
        n(health & ~there).alias("h_gt_null"), _n("health-correct-null").alias("h_correct_null"), _n("health-hallucinated-pass").alias("h_hallucinated_pass"), _n("health-hallucinated-problem").alias("h_hallucinated_problem"), _n("silent-not-tested").alias("h_silent_not_tested"),
        n(health & there).alias("h_gt_state"), _n("health-correct").alias("h_correct_state"), _n("health-wrong-state").alias("h_wrong_state"), _n("health-miss").alias("h_miss"), n(health & (v == "excused")).alias("h_miss_excused"), n((v == "health-miss") & passed).alias("h_clean_dropped"),
        n(health & passed).alias("h_gt_passed"), n((v == "health-correct") & passed).alias("h_gt_passed_correct"),
    )


def corpus_counters(counted: DataFrame, reports: DataFrame, names: list[str], by: str = "slug") -> DataFrame:
    """Sums of counters over all reports; one without cells counts as a report that is not scored, and adds nothing."""
    both = reports.select(by).join(counted.withColumn("scored__", F.lit(True)), by, "left")
    return both.agg(F.count("*").alias("n_reports"), F.count_if("scored__").alias("n_scored"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def report_flags(counted: DataFrame) -> DataFrame:
    """counted with flags: what a report should be looked at for, in a fixed order (hazard_pair and off_schema say whether a pair of fields was torn apart and whether the shape was off)."""
    c = F.col
    marks = ((c("hallucination_hard") > 0, "HALLUC"), (c("rvalue_conversion") > 0, "RCONV"), (c("h_hallucinated_pass") > 0, "HPASS"), (c("span_fabricated") + c("span_missing") > 0, "SPAN"), (c("hazard_pair"), "FUELDROP"), (c("off_schema"), "SCHEMA"))
    return counted.withColumn("flags", F.array_compact(F.array(*(F.when(on, name) for on, name in marks))))


def run_gate(shapes: DataFrame, hazards: DataFrame, by: list[str]) -> DataFrame:
    """By run: whether it passes (every slug scored, no hazard, every shape conforming), and how many shapes conformed at the first try, after more, and never. shapes: by, slug, scored, conforming, attempts; hazards: by and n_hazards, null for none."""
    ok = F.coalesce("conforming", F.lit(False))
    n = shapes.groupBy(*by).agg(
        F.bool_and("scored").alias("all_scored"), F.bool_and(ok).alias("all_conforming"), F.count_if(ok & (F.col("attempts") == 1)).alias("first_try"), F.count_if(ok & (F.col("attempts") > 1)).alias("retried"), F.count_if(~ok).alias("never")
    )
    joined = n.join(hazards, by, "left").withColumn("n_hazards", F.coalesce("n_hazards", F.lit(0)))
    return joined.withColumn("passed", F.col("all_scored") & F.col("all_conforming") & (F.col("n_hazards") == 0)).drop("all_scored", "all_conforming")


def with_delta(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Each of the base's rows with the other run's value and the difference; both null where the other has no such row."""
    there = other.select(key, F.col(value).alias("other"))
    return base.select(key, F.col(value).alias("base")).join(there, key, "left").withColumn("delta", F.col("base") - F.col("other"))


def lost(truth: DataFrame, base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cells (slug, path, value) that are true and that the base has, and the candidate has not."""
    had = base.where("value IS NOT NULL").select("slug", "path", F.col("value").alias("base"))
    has = candidate.where("value IS NOT NULL").select("slug", "path")
    return truth.where("value IS NOT NULL").select("slug", "path", F.col("value").alias("truth")).join(had, ["slug", "path"]).join(has, ["slug", "path"], "left_anti")


def fresh_baseline(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """runs (fingerprint, backend, ...) with the baseline's rate, if it has the same fingerprint and the same backend; else null."""
    return runs.join(baselines.select("fingerprint", "backend", F.col("rate").alias("baseline_rate")), ["fingerprint", "backend"], "left")


def colliding_names(vocabulary: DataFrame) -> DataFrame:
    """Names of a path's vocabulary (path, member, name) that stand for several members."""
    return vocabulary.groupBy("path", "name").agg(F.count_distinct("member").alias("n")).where("n > 1")
