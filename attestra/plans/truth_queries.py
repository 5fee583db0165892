"""Truth against models, runs against baselines, and what is sent to a model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions import numbers as N
from attestra.operators import extraction as X
from attestra.operators import review as V
from attestra.operators import scoring as C
from attestra.operators.constraints import Constraints, violations
from attestra.plans.tables import CELLS, VERDICTS, cells, table
from attestra.sources.batch_runner import BatchRunner
from attestra.sources.folders import shared_folder

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PATHS = [f"group.leaf{k}" for k in range(1, 8)]


def _sides(spark, sf_dir):
    """Truth, and a model's word, of each slug and path, as separate tables; some slugs have no answer."""
    c = cells(spark, sf_dir)
    one = lambda *names: c.groupBy("slug", "path").agg(F.min_by(F.struct(*names), F.struct("part", "supplier")).alias("r")).select("slug", "path", "r.*")
    truth = one("truth", "alternatives", "retracted", "acceptable_miss", "text")
    model = one("value", "source_span", "confidence").where("slug % 5 != 0")
    return truth, model


@query(f"""WITH {CELLS}, t AS (SELECT slug, path, arg_min({{'truth': truth, 'miss': acceptable_miss}}, (part, supplier)) AS t, arg_min({{'value': value}}, (part, supplier)) AS m FROM c5 GROUP BY ALL),
s AS (SELECT CAST(o_orderkey AS VARCHAR) AS slug, 'group.leaf' || n AS path FROM orders, range(1, 8) r(n)), g AS (SELECT s.slug, s.path, t.t.truth AS truth, CASE WHEN CAST(s.slug AS BIGINT) % 5 <> 0 THEN t.m.value END AS value, t.t.miss AS miss FROM s LEFT JOIN t USING (slug, path))
SELECT path, count(*) AS n, count(truth) AS n_true, count(value) AS n_said, count(*) FILTER (truth IS NULL AND value IS NULL) AS n_silent, count(*) FILTER (truth IS NOT NULL AND value IS NULL AND coalesce(miss, false)) AS n_excused FROM g GROUP BY path""")
def jon_truth_and_model(spark, sf_dir):
    """JON-01: a fixed inventory of paths for every slug, with what truth and model say of each; without an answer all is null."""
    truth, model = _sides(spark, sf_dir)
    slugs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("slug"))
    g = C.grid(slugs, _PATHS, truth, model)
    none = F.col("value").isNull()
    return g.groupBy("path").agg(F.count("*").alias("n"), F.count("truth").alias("n_true"), F.count("value").alias("n_said"), F.count_if(F.col("truth").isNull() & none).alias("n_silent"), F.count_if(F.col("truth").isNotNull() & none & F.coalesce("acceptable_miss", F.lit(False))).alias("n_excused"))


_EXTRA = """x AS (SELECT *, k5 AS k, CASE kind WHEN 'enum' THEN CASE WHEN is_health THEN ['Passed', 'Warning', 'Failed'] ELSE ['A', 'N', 'R'] END END AS options, k5 % 4 = 2 AS by_name, is_band AND k5 % 3 = 0 AS converted FROM (SELECT *, part AS k5 FROM j)),
y AS (SELECT *, CASE WHEN kind = 'enum' AND value IS NOT NULL THEN CASE WHEN NOT list_contains(options, value) THEN 'invalid' WHEN list_contains(options, truth) AND abs(list_position(options, truth) - list_position(options, value)) = 1 THEN 'boundary' END END AS tag, NOT is_health AND verdict IN ('correct', 'wrong', 'retracted') AS cmp FROM x)"""
_COUNTERS = {
    "gt_null": "NOT is_health AND truth IS NULL", "gt_non_null": "NOT is_health AND truth IS NOT NULL", "correct_null": "truth IS NULL AND value IS NULL", "hallucination_hard": "verdict = 'hallucination'", "hallucination_soft": "verdict = 'soft'", "unscorable": "verdict = 'unscorable'", "miss": "verdict = 'miss'",
    "miss_excused": "NOT is_health AND verdict = 'excused'", "both_non_null": "truth IS NOT NULL AND value IS NOT NULL", "correct": "NOT is_health AND verdict = 'correct'", "wrong": "verdict IN ('wrong', 'retracted')", "rvalue_conversion": "truth IS NULL AND value IS NOT NULL AND converted",
    "enum_gt_member": "cmp AND kind = 'enum'", "enum_correct": "cmp AND kind = 'enum' AND verdict = 'correct'", "enum_wrong_member": "cmp AND kind = 'enum' AND verdict <> 'correct' AND tag IS NULL", "enum_invalid": "cmp AND kind = 'enum' AND verdict <> 'correct' AND tag = 'invalid'",
    "enum_miss": "verdict = 'miss' AND kind = 'enum'", "enum_sanctioned": "verdict = 'sanctioned'", "vocab_api": "verdict IN ('correct', 'health-correct') AND kind = 'enum' AND NOT by_name", "vocab_slug": "verdict IN ('correct', 'health-correct') AND kind = 'enum' AND by_name",
    "band_gt": "cmp AND is_band", "band_correct": "cmp AND is_band AND verdict = 'correct'", "band_boundary": "cmp AND is_band AND verdict <> 'correct' AND tag IS NOT DISTINCT FROM 'boundary'", "band_wrong": "cmp AND is_band AND verdict <> 'correct' AND tag IS DISTINCT FROM 'boundary'", "band_miss": "verdict = 'miss' AND is_band",
    "span_checked": "value IS NOT NULL", "span_verbatim": "value IS NOT NULL AND span_issue IS NULL", "span_near_miss": "value IS NOT NULL AND span_issue = 'near-miss'", "span_fabricated": "value IS NOT NULL AND span_issue = 'fabricated'", "span_missing": "value IS NOT NULL AND span_issue = 'missing'",
    "h_gt_null": "is_health AND truth IS NULL", "h_correct_null": "verdict = 'health-correct-null'", "h_hallucinated_pass": "verdict = 'health-hallucinated-pass'", "h_hallucinated_problem": "verdict = 'health-hallucinated-problem'", "h_silent_not_tested": "verdict = 'silent-not-tested'", "h_gt_state": "is_health AND truth IS NOT NULL",
    "h_correct_state": "verdict = 'health-correct'", "h_wrong_state": "verdict = 'health-wrong-state'", "h_miss": "verdict = 'health-miss'", "h_miss_excused": "is_health AND verdict = 'excused'", "h_clean_dropped": "verdict = 'health-miss' AND truth = 'Passed'", "h_gt_passed": "is_health AND truth = 'Passed'", "h_gt_passed_correct": "verdict = 'health-correct' AND truth = 'Passed'",
}
_COUNTED = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTERS.items())


def _counted(spark, sf_dir, by):
    part = F.col("part")
    options = F.when(F.col("kind") == "enum", F.when(F.col("is_health"), F.array(*map(F.lit, ("Passed", "Warning", "Failed")))).otherwise(F.array(*map(F.lit, "ANR"))))
    judged = C.verdict(cells(spark, sf_dir)).withColumn("options", options).withColumn("by_name", part % 4 == 2).withColumn("converted", F.col("is_band") & (part % 3 == 0))
    return C.counters(judged, by)


@query(f"WITH {VERDICTS}, {_EXTRA} SELECT slug, {_COUNTED} FROM y GROUP BY slug")
def score_counters(spark, sf_dir):
    """AGG-04: all 43 counters of each report."""
    return _counted(spark, sf_dir, ["slug"])


@query(f"WITH {VERDICTS}, {_EXTRA}, c AS (SELECT slug, {_COUNTED} FROM y GROUP BY slug) SELECT (SELECT count(*) FROM orders) AS n_reports, count(*) AS n_scored, " + ", ".join(f"coalesce(CAST(sum({n}) AS BIGINT), 0) AS {n}" for n in _COUNTERS) + " FROM c SEMI JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS slug FROM orders) o USING (slug)")
def score_corpus_counters(spark, sf_dir):
    """AGG-05: sums over all reports, those that are not scored among them."""
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("slug"))
    return C.corpus_counters(_counted(spark, sf_dir, ["slug"]), reports, list(_COUNTERS))


@query(f"""WITH {VERDICTS}, {_EXTRA}, c AS (SELECT slug, {_COUNTED} FROM y GROUP BY slug) SELECT slug, list_filter([CASE WHEN hallucination_hard > 0 THEN 'HALLUC' END, CASE WHEN rvalue_conversion > 0 THEN 'RCONV' END, CASE WHEN h_hallucinated_pass > 0 THEN 'HPASS' END, CASE WHEN span_fabricated + span_missing > 0 THEN 'SPAN' END,
  CASE WHEN CAST(slug AS BIGINT) % 7 = 0 THEN 'FUELDROP' END, CASE WHEN CAST(slug AS BIGINT) % 11 = 0 THEN 'SCHEMA' END], lambda f: f IS NOT NULL) AS flags FROM c""")
def score_report_flags(spark, sf_dir):
    """AGG-15: what each report should be looked at for."""
    k = F.col("slug").cast("long")
    return C.report_flags(_counted(spark, sf_dir, ["slug"]).withColumn("hazard_pair", k % 7 == 0).withColumn("off_schema", k % 11 == 0)).select("slug", "flags")


@query("""WITH s AS (SELECT o_custkey % 50 AS run, o_orderkey % 997 <> 1 AS scored, o_orderkey % 499 <> 2 AS ok, o_orderkey % 3 + 1 AS attempts FROM orders), h AS (SELECT o_custkey % 50 AS run, count(*) AS n FROM orders WHERE o_orderkey % 1499 = 3 GROUP BY 1)
SELECT run, count(*) FILTER (ok AND attempts = 1) AS first_try, count(*) FILTER (ok AND attempts > 1) AS retried, count(*) FILTER (NOT ok) AS never, coalesce(any_value(n), 0) AS n_hazards, bool_and(scored) AND bool_and(ok) AND coalesce(any_value(n), 0) = 0 AS passed FROM s LEFT JOIN h USING (run) GROUP BY run""")
def score_run_gate(spark, sf_dir):
    """PRJ-30, AGG-23: a run passes if all is scored, no hazard is found and every shape conforms; shapes by the tries they took."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("run"), k.alias("slug"), (k % 997 != 1).alias("scored"), (k % 499 != 2).alias("conforming"), (k % 3 + 1).alias("attempts"))
    return C.run_gate(o, o.where("slug % 1499 = 3").groupBy("run").agg(F.count("*").alias("n_hazards")), ["run"])


@query("""WITH a AS (SELECT l_orderkey AS slug, round(avg(l_discount), 9) AS wer FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS slug, round(avg(l_tax), 9) AS wer FROM lineitem WHERE l_orderkey % 3 <> 1 GROUP BY 1) SELECT slug, a.wer AS base, b.wer AS other, round(a.wer - b.wer, 9) AS delta FROM a LEFT JOIN b USING (slug)""")
def jon_hint_delta(spark, sf_dir):
    """JON-09: each slug's rate without and with a hint, and the difference; null where there is no other."""
    n = table(spark, sf_dir, "lineitem")
    rate = lambda rows, c: rows.groupBy(F.col("l_orderkey").alias("slug")).agg(F.round(F.avg(c), 9).alias("wer"))
    return C.with_delta(rate(n, "l_discount"), rate(n.where("l_orderkey % 3 != 1"), "l_tax"), "slug", "wer").withColumn("delta", F.round("delta", 9))


@query(f"""WITH {CELLS}, v AS (SELECT slug, path, min(truth) AS truth, min(value) FILTER (part % 3 <> 0) AS base, min(value) FILTER (part % 4 <> 0) AS candidate FROM c5 GROUP BY ALL) SELECT slug, path, truth, base FROM v WHERE truth IS NOT NULL AND base IS NOT NULL AND candidate IS NULL""")
def jon_lost_by_candidate(spark, sf_dir):
    """JON-10: true cells that the baseline has and the candidate dropped."""
    c = cells(spark, sf_dir)
    of = lambda rows, v: rows.groupBy("slug", "path").agg(F.min(v).alias("value"))
    return C.lost(of(c, "truth"), of(c.where("part % 3 != 0"), "value"), of(c.where("part % 4 != 0"), "value"))


@query(f"""WITH {VERDICTS}, r AS (SELECT part % 2 = 0 AS clean, count(*) FILTER (verdict = 'hallucination') / count(*) FILTER (NOT is_health AND truth IS NULL) AS hallucination_rate, count(*) FILTER (verdict = 'correct') / count(*) FILTER (verdict IN ('correct', 'wrong', 'retracted')) AS accuracy FROM j GROUP BY 1)
SELECT round(a.hallucination_rate, 9) AS clean_hallucination_rate, round(b.hallucination_rate, 9) AS noisy_hallucination_rate, round(b.hallucination_rate - a.hallucination_rate, 9) AS hallucination_delta, round(a.accuracy, 9) AS clean_accuracy, round(b.accuracy, 9) AS noisy_accuracy, round(b.accuracy - a.accuracy, 9) AS accuracy_delta FROM r a, r b WHERE a.clean AND NOT b.clean""")
def jon_clean_and_noisy(spark, sf_dir):
    """JON-11: rates over clean and over noisy texts, side by side with their differences; one aggregate for both."""
    j = C.verdict(cells(spark, sf_dir)).withColumn("clean", F.col("part") % 2 == 0)
    v, clean = F.col("verdict"), F.col("clean")
    share = lambda side, n, d: F.try_divide(F.count_if(side & n), F.count_if(side & d))
    parts = {"hallucination_rate": (v == "hallucination", ~F.col("is_health") & F.col("truth").isNull()), "accuracy": (v == "correct", v.isin("correct", "wrong", "retracted"))}
    one = j.agg(*(share(side, n, d).alias(f"{name}_{c}") for c, (n, d) in parts.items() for name, side in (("clean", clean), ("noisy", ~clean))))
    delta = lambda c: F.round(F.col(f"noisy_{c}") - F.col(f"clean_{c}"), 9)
    return one.select(*(F.round(c, 9).alias(c) for c in one.columns), delta("hallucination_rate").alias("hallucination_delta"), delta("accuracy").alias("accuracy_delta"))


@query("""WITH r AS (SELECT o_orderkey AS run, md5(o_orderpriority) AS fingerprint, o_orderstatus AS backend FROM orders), b AS (SELECT md5(o_orderpriority) AS fingerprint, o_orderstatus AS backend, min(o_totalprice) AS rate FROM orders WHERE o_orderpriority < '4' AND o_orderstatus <> 'P' GROUP BY ALL) SELECT run, rate AS baseline_rate FROM r LEFT JOIN b USING (fingerprint, backend)""")
def jon_fresh_baseline(spark, sf_dir):
    """JON-16: a baseline counts only for runs of the same schema and the same backend."""
    o = table(spark, sf_dir, "orders")
    key = [F.md5("o_orderpriority").alias("fingerprint"), F.col("o_orderstatus").alias("backend")]
    baselines = o.where("o_orderpriority < '4' AND o_orderstatus != 'P'").groupBy(*key).agg(F.min("o_totalprice").alias("rate"))
    return C.fresh_baseline(o.select(F.col("o_orderkey").alias("run"), *key), baselines).select("run", "baseline_rate")


@query("SELECT c_custkey AS recording, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'canned text' END AS text FROM customer")
def jon_canned_answers(spark, sf_dir):
    """JON-17, UDF-15: a double's canned answer for a recording, else its default."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording"), F.col("c_name").alias("text"))
    return X.canned(c, c.where("recording % 3 = 0"), "recording", "text", "canned text")


@query("SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand) AS description FROM part")
def jon_descriptions(spark, sf_dir):
    """JON-19: the vendor's description, where there is one, and the own note."""
    p = table(spark, sf_dir, "part")
    return X.described_fields(p, p.where("p_size % 2 = 0"), "p_partkey", "p_type", "p_brand")


@query("""SELECT p_brand AS path, split_part(p_name, ' ', 2) AS name, count(DISTINCT p_name) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_name) > 1""")
def agg_colliding_names(spark, sf_dir):
    """LST-12: names in a vocabulary that stand for several members."""
    name = F.split_part("p_name", F.lit(" "), F.lit(2))
    return C.colliding_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("member"), name.alias("name")))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '{"n":' || event_id || '}' END AS value,
CAST(CASE event_id % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN event_id % 9 IN (0, 1, 3) THEN event_type END AS source_span FROM events""")
def lst_envelopes(spark, sf_dir):
    """LST-05, LST-08: envelopes from JSON, confidence clamped; what is malformed (a word or nothing as confidence, no sourceSpan or one that is no string, no object) reads as a leaf left out, value and all."""
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    forms = [
        '{"value": "%1$s", "confidence": 7, "sourceSpan": "%2$s"}', '{"value": %1$s, "confidence": 0.25, "sourceSpan": "%2$s", "more": 1}', '{"value": {"n": %1$s}, "confidence": 0.5, "sourceSpan": null}', '{"confidence": 5e-1, "sourceSpan": "%2$s"}',
        '{"value": "%1$s", "confidence": "high", "sourceSpan": "%2$s"}', '{"value": "%1$s", "sourceSpan": "%2$s"}', '{"value": "%1$s", "confidence": 0.5}', '{"value": "%1$s", "confidence": 0.5, "sourceSpan": 5}', "no envelope %1$s {",
    ]
    json = F.element_at(F.array(*(F.format_string(f, i, kind) for f in forms)), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", V.read_envelope(json).alias("e")).select("event_id", "e.*")


@query("""SELECT event_id, x.path AS path, x.value AS value, CAST(x.confidence AS DOUBLE) AS confidence, x.span AS source_span FROM (SELECT event_id, unnest([{'path': 'a', 'value': CAST(event_id AS VARCHAR), 'confidence': 1.0, 'span': NULL}, {'path': 'b.1.d', 'value': event_type, 'confidence': 0.5, 'span': event_type},
{'path': 'f' || repeat('.d', CAST(event_id % 30 AS INT)), 'value': CAST(event_id AS VARCHAR), 'confidence': 0.0, 'span': NULL}]) AS x FROM events)""")
def lst_loose_leaves(spark, sf_dir):
    """PRJ-33, LST-08: leaves of objects and lists without a schema, down to thirty levels here and to any depth."""
    i, kind, deep = F.col("event_id").cast("string"), F.col("event_type"), (F.col("event_id") % 30).cast("int")
    leaf = lambda v, c, q: F.format_string(f'{{"value": "%s", "sourceSpan": {q}, "confidence": {c}}}', v)
    nested = F.concat(F.repeat(F.lit('{"d": '), deep), leaf(i, '"high"', "null"), F.repeat(F.lit("}"), deep))
    json = F.concat(F.lit('{"a": '), leaf(i, 3, "null"), F.lit(', "n": 5, "b": [7, {"d": '), F.format_string('{"value": "%1$s", "sourceSpan": "%1$s", "confidence": 0.5}', kind), F.lit(', "e": "x"}], "f": '), nested, F.lit("}"))
    return V.loose_leaves(table(spark, sf_dir, "events").select("event_id", json.alias("json")), "json")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id END AS n, CASE event_id % 5 WHEN 1 THEN 'answer: no JSON object' WHEN 2 THEN 'answer: missing n' WHEN 3 THEN 'answer: unknown m' WHEN 4 THEN 'answer: wrong kind of n' END AS error FROM events""")
def lst_parsed(spark, sf_dir):
    """LST-17, LST-18: JSON against a strict schema, with what is wrong and where."""
    k, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    json = F.when(k == 0, F.concat(F.lit('{"n": '), i, F.lit("}"))).when(k == 1, F.concat(F.lit("n is "), i)).when(k == 2, "{}").when(k == 3, F.concat(F.lit('{"n": '), i, F.lit(', "m": 1}'))).otherwise('{"n": "many"}')
    got = V.parsed(json, T.StructType([T.StructField("n", T.LongType())]), F.lit("answer"))
    return table(spark, sf_dir, "events").select("event_id", got.alias("g")).select("event_id", "g.fields.n", "g.error")


@query("SELECT user_id AS path, min_by(event_type || event_id, (ts, event_id)) AS message FROM events GROUP BY user_id")
def agg_first_issues(spark, sf_dir):
    """AGG-30: of each path the message that came first."""
    issues = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.struct("ts", "event_id").alias("ord"), F.concat("event_type", "event_id").alias("message"))
    return V.first_issues(issues)


@query(r"""WITH r AS (SELECT conv_id, turn % 12 + 1 AS number, min(text) AS text FROM conversations GROUP BY ALL), b AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY number, text) FILTER (number <= 6) AS base, string_agg(text, chr(10) || chr(10) ORDER BY number, text) FILTER (number > 6) AS more FROM r GROUP BY conv_id)
SELECT conv_id, md5('You extract.' || 'Rules:' || coalesce(base, '') || CASE WHEN more IS NOT NULL THEN 'Forms:' || more ELSE '' END || 'Put out JSON.' || 'Text:') AS said FROM b""")
def str_instructions(spark, sf_dir):
    """STR-29: rules under two headings, and the text's marker last."""
    rules = table(spark, sf_dir, "conversations").groupBy("conv_id", (F.col("turn") % 12 + 1).alias("number")).agg(F.min("text").alias("text"))
    lists = rules.groupBy("conv_id").agg(F.collect_list(F.struct("number", "text")).alias("rules"))
    return lists.select("conv_id", F.md5(X.instructions(F.col("rules"), "You extract.", "Rules:", "Forms:", "Put out JSON.", "Text:")).alias("said"))


_TURNS = "concat_ws('|', 'system:rules', CASE WHEN {keep} THEN 'user:shown' END, CASE WHEN {keep} THEN 'assistant:' || {fields} END, 'user:' || p_name)"


@query("SELECT p_partkey, md5(" + _TURNS.format(keep="true", fields="""'{"price":"' || p_size || '","state":"' || p_brand || '"}'""") + ") AS whole, CASE WHEN p_size % 2 = 0 THEN md5(" + _TURNS.format(keep="true", fields="""'{"price":"' || p_size || '"}'""") + ") ELSE md5('system:rules|user:' || p_name) END AS of_group FROM part")
def lst_conversations(spark, sf_dir):
    """LST-20, LST-21, PRJ-18: instructions, examples and text as turns; for a group only its fields, and no example without it."""
    fields = F.create_map(F.lit("price"), F.col("p_size").cast("string"), F.lit("state"), F.col("p_brand"))
    examples = F.array(F.struct(F.lit("shown").alias("text"), fields.alias("fields")))
    line = lambda turns: F.md5(F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["content"])), "|"))
    group = F.when(F.col("p_size") % 2 == 0, "price").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", line(X.conversation(F.lit("rules"), examples, F.col("p_name"))).alias("whole"), line(X.conversation(F.lit("rules"), examples, F.col("p_name"), group)).alias("of_group"))


@query("SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 200 ELSE 300 END + CASE WHEN p_size % 2 = 0 THEN 7 ELSE 0 END AS INT) AS bytes FROM part")
def mth_download_sizes(spark, sf_dir):
    """MTH-14: known sizes by model, a fallback, and what comes with each."""
    k = F.col("p_size") % 3
    sizes = F.create_map(F.lit("a"), F.lit(100), F.lit("b"), F.lit(200))
    return table(spark, sf_dir, "part").select("p_partkey", N.download_size(F.when(k == 0, "a").when(k == 1, "b").otherwise("c"), sizes, 300, 7, F.col("p_size") % 2 == 0).alias("bytes"))


@query("""SELECT p_partkey, coalesce(list_max(list_filter(range(0, p_size % 9 + 1), lambda r: (p_size % 4 + 1) * ((r + 1) * 120000 + list_sum(list_concat([0.0], list_transform(range(0, r), lambda k: least(30000.0, 1000.0 * pow(2, k)))))) <= 900000)), 0) AS retries FROM part""")
def mth_retries(spark, sf_dir):
    """MTH-06: the most retries whose worst case fits the step's budget."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.retries_that_fit(s % 9, s % 4 + 1, 900_000, 120_000, 1000, 30_000).alias("retries"))


@query("SELECT user_id, count(*) AS n_segments, round(sum(value), 6) AS duration, round(sum(value * (event_id % 7) / 5.0) / nullif(sum(value), 0), 9) AS rtf, round(avg(value) FILTER (event_type = 'view'), 6) AS duty FROM events GROUP BY user_id")
def agg_recording_totals(spark, sf_dir):
    """AGG-16, AGG-34, AGG-36: segments and durations, the real-time factor as a ratio of sums, and the mean of a duty cycle."""
    value = F.col("value")
    segments = table(spark, sf_dir, "events").select("user_id", value.alias("duration"), (value * (F.col("event_id") % 7) / 5).alias("elapsed"), F.when(F.col("event_type") == "view", value).alias("duty"))
    return X.recording_totals(segments, "user_id").select("user_id", "n_segments", F.round("duration", 6).alias("duration"), F.round("rtf", 9).alias("rtf"), F.round("duty", 6).alias("duty"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value WHEN event_id % 5 = 1 THEN CAST(event_id AS DOUBLE) END AS rtf FROM events")
def prj_measured_rtf(spark, sf_dir):
    """SRC-34: a stored verdict's number; a malformed one (no number, no JSON, none at all) is as good as none."""
    k = F.col("event_id") % 5
    verdict = F.when(k == 0, F.to_json(F.struct(F.col("value").alias("rtf")))).when(k == 1, F.format_string('{"rtf": %s, "at": "x"}', F.col("event_id").cast("string"))).when(k == 2, F.format_string('{"rtf": "%s"}', F.col("event_id").cast("string"))).when(k == 3, F.concat(F.lit('{"rtf": '), F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", X.measured_rtf(verdict).alias("rtf"))


@query("""SELECT 'r' || event_id AS slug, CASE event_id % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'no object' WHEN 4 THEN 'absent' END AS problem FROM events""")
def src_loaded(spark, sf_dir):
    """SRC-20: every slug's result, or whether it is absent, empty, malformed or no object."""
    from attestra.sources.json_text import loaded

    k = F.col("event_id") % 5
    slug = F.concat(F.lit("r"), F.col("event_id")).alias("slug")
    text = F.when(k == 0, F.col("props")).when(k == 1, " ").when(k == 2, F.concat(F.lit("{"), F.col("props"))).otherwise("[1]")
    e = table(spark, sf_dir, "events")
    return loaded(e.where(k != 4).select(slug, text.alias("text")), e.select(slug)).select("slug", "problem")


_SHAPE = """g AS (SELECT o_custkey % 50 AS run, nullif(o_orderpriority, CASE WHEN o_custkey % 50 = 7 THEN '5-LOW' ELSE '' END) AS path, o_orderstatus AS slug, o_orderkey % 3 AS kind, o_orderkey AS k FROM orders WHERE o_custkey % 50 < 25 OR o_orderstatus <> 'P' OR o_orderpriority < '4'),
n AS (SELECT run, count(*) FILTER (path IS NULL) AS no_path, count(*) AS n, count(DISTINCT (path, slug, kind)) AS keys, count(DISTINCT (path, slug)) AS cells, count(DISTINCT {'p': path}) * count(DISTINCT slug) AS grid FROM g GROUP BY run)"""


@query(f"WITH {_SHAPE} SELECT run, x.problem AS problem, x.n AS n FROM (SELECT run, unnest([{{'problem': 'no path', 'n': no_path}}, {{'problem': 'not unique: path, slug, kind', 'n': n - keys}}, {{'problem': 'not dense: path, slug', 'n': grid - cells}}]) AS x FROM n) WHERE x.n <> 0")
def src_shape_problems(spark, sf_dir):
    """SRC-31: runs that lack required values, have cells twice, or whose grid of paths and slugs is not dense, from one declaration in one pass."""
    run = F.col("o_custkey") % 50
    o = table(spark, sf_dir, "orders").where("o_custkey % 50 < 25 OR o_orderstatus != 'P' OR o_orderpriority < '4'")
    cells = o.select(run.alias("run"), F.when((run != 7) | (F.col("o_orderpriority") != "5-LOW"), F.col("o_orderpriority")).alias("path"), F.col("o_orderstatus").alias("slug"), (F.col("o_orderkey") % 3).alias("kind"))
    return violations(cells, ["run"], Constraints(("path", "slug"), (("path", "slug", "kind"),), (("path", "slug"),)))


@query("SELECT 'customer ' || c_custkey AS slug, CASE WHEN c_custkey % 9 = 4 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN c_custkey % 9 <> 4 THEN upper(c_name) END AS result, CASE WHEN c_custkey % 9 = 4 THEN 'ValueError: unfit' END AS error FROM customer")
def src_batch_run(spark, sf_dir):
    """SRC-47: a batch run that breaks off half way and is taken up again: what has a result is skipped, failures are tried again."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey")).alias("slug"), F.concat(F.col("c_custkey") % 9, F.lit(" "), F.col("c_name")).alias("text"))

    def work(text: str) -> str:
        k, name = text.split(" ", 1)
        if k == "4":
            raise ValueError("unfit")
        return name.upper()

    def breaks(wave: int) -> None:
        if wave == 4:
            raise RuntimeError("breaks off")

    root = shared_folder(spark, "batch")
    try:
        BatchRunner(spark, root, work, before_wave=breaks).run(c)
    except RuntimeError:
        runner = BatchRunner(spark, root, work)
        runner.run(c)
    return runner.results()
