"""The operators as registered queries, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import conversation_repair, decontaminate, fill_in_middle, language_model, near_duplicates, personal_data, quality_classifier, quality_rules, repeated_spans, secrets, source_mixing, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


#: Where the public vocabulary lies.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Target weights of the sources; those not named have 1.
WEIGHTS = {"src0": 4.0, "src1": 2.5, "src2": 1.5, "src3": 0.5}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.vocabulary(VOCABULARY))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.without_repeated_spans(_table(spark, sf_dir, "documents")).drop("kept")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.with_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(_table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.with_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_counts, op3_repeated_spans, op4_source_mixing, op5_near_duplicates, op6_personal_data, op7_language_model, op8_secrets, op9_decontaminate, op10_quality_classifier,
        op11_fill_in_middle, op12_conversation_repair, op13_toxicity,
    )
}

#: Twice each weight, a whole number.
_WEIGHT = "CASE source " + " ".join(f"WHEN '{name}' THEN {int(2 * w)}" for name, w in WEIGHTS.items()) + " ELSE 2 END"

ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS nr FROM documents
), t AS (SELECT key, CAST({_WEIGHT} AS BIGINT) AS weight, ceil(count(*) / {source_mixing.BLOCK}.0) AS blocks FROM d GROUP BY key, source
), s AS (SELECT key, weight // (SELECT list_reduce(list(weight), lambda x, y: gcd(x, y)) FROM t) AS a, blocks FROM t
), q AS (SELECT key, a, CAST(ceil(blocks / a) AS BIGINT) AS periods FROM s
), ends AS (SELECT DISTINCT periods AS until FROM q
), phase AS (SELECT until, coalesce(lag(until) OVER (ORDER BY until), 0) AS since FROM ends
), part AS (SELECT until, since, list(key ORDER BY key) AS keys, list(a ORDER BY key) AS a, CAST(sum(a) AS BIGINT) AS size FROM phase JOIN q ON q.periods >= phase.until GROUP BY until, since
), placed AS (SELECT *, CAST(coalesce(sum((until - since) * size) OVER (ORDER BY until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM part
), sim AS (
  SELECT until, a, size, CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS nth FROM placed
  UNION ALL
  SELECT until, a, size, t + 1, list_transform(range(1, len(a) + 1), lambda j: done[j] + CAST(j = best.i AS BIGINT)), best.i, done[best.i] FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN done[j] < a[j] AND (done[j] * size) // a[j] <= t + 1 THEN {{'deadline': ((done[j] + 1) * size + a[j] - 1) // a[j], 'i': j}} END), lambda x: x IS NOT NULL)) AS best FROM sim WHERE t + 1 < size)
), slots AS (SELECT keys[sim.i] AS key, placed.a[sim.i] AS a, since, placed.until, first, placed.size, nth, t FROM sim JOIN placed USING (until) WHERE sim.t >= 0)
SELECT doc_id, source, nr // {source_mixing.BLOCK} AS block, first + (nr // {source_mixing.BLOCK} // a - since) * size + t AS slot, nr % {source_mixing.BLOCK} AS place
FROM d JOIN slots ON slots.key = d.key AND nr // {source_mixing.BLOCK} // a >= since AND nr // {source_mixing.BLOCK} // a < until AND nth = nr // {source_mixing.BLOCK} % a
""",
    "op5_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS s FROM d, range(1, greatest(len(w) - 4, 1) + 1) r(k) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 10 * c >= 8 * (i.n + j.n - c)
), both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reached r JOIN both_ways b ON b.x = r.doc_id)
SELECT doc_id, min(root) AS class_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
""",
    "op9_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM i, range(1, greatest(len(w) - 9, 1) + 1) r(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM iw), texts AS (SELECT DISTINCT n, s FROM iw
), dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, sizes, range(1, len(w) - n + 2) r(k) WHERE len(w) >= n
), m AS (SELECT dw.* FROM dw JOIN texts USING (n, s)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, range(k, k + n) r(p) GROUP BY doc_id
), ids AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM m JOIN iw USING (n, s) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op11_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h
), f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(key) + 1), lambda j: [CAST(ascii(key[j]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295) % 20 AS kind FROM c
), d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd FROM o
), n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, max(i) AS last FROM f GROUP BY conv_id
), arcs AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) a(s, c, t)
), t AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, [{'s': 0, 'c': 0, 'a': '', 'r': ''}] AS best FROM n
  UNION ALL
  SELECT conv_id, i, list(b) FROM (
    SELECT conv_id, i, min({'s': s, 'c': c, 'a': a, 'r': r}) AS b FROM (
      SELECT conv_id, i, unnest(flatten(list_transform(best, lambda b: list_concat(
        [{'s': b.s, 'c': b.c + 2, 'a': b.a || 'D', 'r': b.r}],
        CASE WHEN fault IN ('blank', 'duplicate') THEN [] ELSE list_concat(
          CASE WHEN (b.s IN (0, 1, 3) AND c = 'u') OR (b.s = 0 AND c = 's') OR (b.s = 2 AND c = 'a') THEN [{'s': CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'c': b.c + late, 'a': b.a || 'K', 'r': b.r || chr(10) || role || ':' || text}] ELSE [] END,
          [{'s': CASE b.s WHEN 2 THEN 3 ELSE 2 END, 'c': b.c + 1 + late, 'a': b.a || 'R', 'r': b.r || chr(10) || CASE b.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || text}]) END))), recursive := true)
      FROM (
        SELECT t.conv_id, f.i, f.role, f.text, f.fault, f.c, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS late, list_concat(best,
          list_transform(best, lambda b: {'s': CASE b.s WHEN 2 THEN 3 ELSE 2 END, 'c': b.c + 5, 'a': b.a || 'I', 'r': b.r || chr(10) || CASE b.s WHEN 2 THEN 'assistant:' ELSE 'user:' END}),
          list_transform(best, lambda b: {'s': CASE b.s WHEN 2 THEN 2 ELSE 3 END, 'c': b.c + 10, 'a': b.a || 'II', 'r': b.r || chr(10) || CASE b.s WHEN 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END})) AS best
        FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1)
    ) GROUP BY conv_id, i, s) GROUP BY conv_id, i
), ends AS (SELECT n.*, list_min(list_transform(best, lambda b: CASE b.s WHEN 0 THEN {'c': b.c, 'a': b.a, 'r': b.r} WHEN 3 THEN {'c': b.c, 'a': b.a, 'r': b.r} WHEN 2 THEN {'c': b.c + 5, 'a': b.a || 'I', 'r': b.r || chr(10) || 'assistant:'} ELSE {'c': b.c + 10, 'a': b.a || 'II', 'r': b.r || chr(10) || 'user:' || chr(10) || 'assistant:'} END)) AS b FROM n JOIN t ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.i = n.last)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS id FROM conversations) LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM id
""",
}
