"""String, number and array functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.functions import strings as S
from attestra.functions import structures as L
from attestra.plans.tables import QUOTES, quotes, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LOOSE = "trim(regexp_replace(translate(lower({0}), '‘’“”', '''''\"\"'), '\\s+', ' ', 'g'))"
_BARE = "trim(regexp_replace(regexp_replace({0}, '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g'))"
_SPOKEN = "trim(regexp_replace(regexp_replace(translate(lower({0}), '‘’“”', '''''\"\"'), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS compact_key, md5({_LOOSE.format("text")}) AS loose, md5({_SPOKEN.format("text")}) AS spoken,
  CAST(len(list_filter(string_split({_SPOKEN.format("text")}, ' '), lambda x: x <> '')) AS INT) AS n_words, regexp_replace(upper(source) || ' / ' || lang, '[^A-Za-z0-9_.-]+', '_', 'g') AS file_label,
  md5(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ') AS keywords,
  md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '{{{{', '&#123;&#123;'), '}}}}', '&#125;&#125;')) AS escaped FROM documents""")
def str_normal_forms(spark, sf_dir):
    """STR-01, 02, 05, 06, 13, 23, 24, 25."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(S.compact_key(t)).alias("compact_key"), F.md5(S.loose_text(t)).alias("loose"), F.md5(S.spoken_text(t)).alias("spoken"), F.size(S.spoken_words(t)).alias("n_words"),
        S.file_label(F.concat(F.upper("source"), F.lit(" / "), F.col("lang"))).alias("file_label"), F.md5(S.padded_words(t)).alias("keywords"), F.md5(S.escaped(t)).alias("escaped"),
    )


_W = "list_filter(string_split({0}, ' '), lambda x: x <> '')".format(_LOOSE.format("span"))


@query(f"""WITH {QUOTES}, n AS (SELECT *, {_LOOSE.format("text")} AS nt, {_LOOSE.format("span")} AS ns, {_W} AS w FROM s),
v AS (SELECT *, coalesce(length(span) > 0 AND (contains(text, span) OR contains(text, regexp_replace(span, '\\s+$', ''))), false) AS verbatim FROM n)
SELECT doc_id, coalesce(length(regexp_replace(span, '\\s+$', '')) > 0 AND contains(text, regexp_replace(span, '\\s+$', '')), false) AS grounded, verbatim,
  CASE WHEN verbatim THEN 'verbatim' WHEN length(span) > 0 AND (contains(nt, ns) OR contains({_BARE.format("nt")}, {_BARE.format("ns")})
    OR (len(w) >= 4 AND len(list_filter(range(1, len(w) - 2), lambda i: contains(nt, array_to_string(w[i:i + 3], ' ')))) > 0)) THEN 'near-miss' ELSE 'fabricated' END AS span_class FROM v""")
def str_span_classes(spark, sf_dir):
    """STR-03, PRJ-11, PRJ-12, JON-08."""
    q, span, text = quotes(spark, sf_dir), F.col("span"), F.col("text")
    return q.select("doc_id", S.is_grounded(span, text).alias("grounded"), S.is_verbatim(span, text).alias("verbatim"), S.span_class(span, text).alias("span_class"))


@query("""WITH x AS (SELECT doc_id, text, [substr(text, 3, 20), substr(text, 30, 12), upper(substr(text, 5, 30)), 'nothing like this'] AS spans FROM documents)
SELECT doc_id, CAST(len(list_filter(spans, lambda s: contains(text, s))) AS INT) AS n_kept, CAST(len(list_filter(spans, lambda s: NOT contains(text, s))) AS INT) AS n_dropped FROM x WHERE len(list_filter(spans, lambda s: contains(text, s))) > 0""")
def prj_evidence_gate(spark, sf_dir):
    """PRJ-13: quotes that the text has; fields without any are dropped."""
    t = F.col("text")
    spans = F.array(F.substring(t, 3, 20), F.substring(t, 30, 12), F.upper(F.substring(t, 5, 30)), F.lit("nothing like this"))
    kept = F.filter("spans", lambda s: F.contains(t, s))
    return table(spark, sf_dir, "documents").withColumn("spans", spans).withColumn("kept", kept).where(F.size("kept") > 0).select("doc_id", F.size("kept").alias("n_kept"), (F.size("spans") - F.size("kept")).alias("n_dropped"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(p_size || '% - ' || p_name || '''s "' || p_type || '"', '^[0-9]+%\s*-\s*', '')), '[''"]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS member_slug,
  upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS sentence, CASE WHEN p_size % 2 = 0 THEN 'Insulation depth ' || p_size ELSE 'Year ' || p_size || ' built' END AS label,
  regexp_replace(regexp_replace(p_name || '/' || p_brand || '-ONNX', '^.*/', ''), '(?i)-onnx$', '') AS model, 'local:' || p_brand || ':' || CASE WHEN p_size % 3 = 0 THEN 'gpu' ELSE 'auto' END || ':auto' AS engine,
  'audio-' || p_partkey || '-' || lpad(CAST(p_size AS VARCHAR), 6, '0') || '-' || lpad(CAST(p_size % 10 AS VARCHAR), 2, '0') AS chunk, true AS of_source,
  CASE WHEN p_size % 4 = 0 THEN p_name || ', ' || p_type || '. ' || p_brand WHEN p_size % 4 = 1 THEN p_brand WHEN p_size % 4 = 2 THEN p_name || ', ' || p_type END AS prompt,
  'a: ' || p_name || '; ' || p_type AS located, 'Group' || ' · ' || 'Leaf ' || p_size AS path_label, CASE p_size % 3 WHEN 0 THEN 'q4f16' WHEN 1 THEN 'fp16' END AS number_kind FROM part""")
def str_labels(spark, sf_dir):
    """STR-04, 10, 11, 12, 14, 16, 17, 18, 19, 20, PRJ-16, SRT-09."""
    name, kind, brand, size = (F.col(f"p_{c}") for c in ("name", "type", "brand", "size"))
    chunk = S.chunk_name(F.col("p_partkey"), size, size % 10)
    path = F.when(size % 2 == 0, F.concat(F.lit("attic.atticInsulationDepth"), size)).otherwise(F.concat(F.lit("base.year"), size, F.lit("Built")))
    terms = F.when(size % 4 == 0, F.array(F.concat(F.lit(" "), name), F.lit(" "), kind)).when(size % 4 == 2, F.array(name, kind)).otherwise(F.array().cast("array<string>"))
    prompt = F.when(size % 4 < 2, F.concat(brand, F.lit(" "))).otherwise(F.lit("  "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.member_slug(F.concat(size, F.lit("% - "), name, F.lit("'s \""), kind, F.lit('"'))).alias("member_slug"), S.sentence_case(brand).alias("sentence"), S.leaf_label(path).alias("label"),
        S.model_short_name(F.concat(name, F.lit("/"), brand, F.lit("-ONNX"))).alias("model"), S.engine_id("local", F.concat(name, F.lit("/"), brand, F.lit("-onnx")), F.when(size % 3 == 0, "gpu"), F.lit(None).cast("string")).alias("engine"),
        chunk.alias("chunk"), S.is_chunk_of(chunk, F.col("p_partkey")).alias("of_source"), F.when(size % 4 != 3, S.hint_prompt(terms, prompt)).alias("prompt"),
        S.located(F.array(F.struct(F.lit("a").alias("path"), name.alias("message")), F.struct(F.lit("").alias("path"), kind.alias("message")))).alias("located"), S.path_label(F.concat(F.lit("group.leaf"), size)).alias("path_label"),
        S.url_kind_suffix(F.when(size % 3 == 0, "m/encoder_q4f16.onnx").when(size % 3 == 1, "m/decoder_fp16.onnx").otherwise("m/decoder.onnx"), ["q4", "q4f16", "fp16", "q8"]).alias("number_kind"),
    )


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, '|')) AS sentences FROM s""")
def str_sentences(spark, sf_dir):
    """STR-21."""
    s = S.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("sentences"))


@query(r"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(list_transform(s, lambda x: len(regexp_split_to_array(x, '\s+')))) AS n FROM s)),
f AS MATERIALIZED (SELECT a.doc_id, a.i, greatest(a.i + 1, coalesce(min(b.i), 1000000000)) AS next FROM w a ASOF LEFT JOIN w b ON a.doc_id = b.doc_id AND a.before + 66 < b.upto GROUP BY a.doc_id, a.i),
t AS (SELECT doc_id, i, next FROM f WHERE i = 1 UNION ALL SELECT f.doc_id, f.i, f.next FROM t JOIN f ON f.doc_id = t.doc_id AND f.i = t.next)
SELECT doc_id, CAST(count(i) AS INT) AS n_pieces, md5(coalesce(string_agg(array_to_string(s[i:next - 1], ' '), '|' ORDER BY i) FILTER (i IS NOT NULL), '')) AS pieces FROM s LEFT JOIN t USING (doc_id) GROUP BY doc_id""")
def str_packed_sentences(spark, sf_dir):
    """STR-22: a fold over the sentences."""
    p = S.packed(S.sentences(F.col("text")), 66)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("n_pieces"), F.md5(F.array_join(p, "|")).alias("pieces"))


_BANDS = "CASE " + " ".join(f"WHEN p_size <= {t} THEN '{n}'" for t, n in N.DEPTH_BANDS[0]) + " ELSE '16+' END"
_AGES = "CASE " + " ".join(f"WHEN p_size <= {t} THEN '{n}'" for t, n in N.AGE_BANDS[0]) + " ELSE '36+' END"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (p_retailprice - 950) / 50)) END AS clamped, {_BANDS} AS depth_band, {_AGES} AS age_band,
  least(60000.0, 1000.0 * pow(2, least(p_size, 32))) AS wait_window, CAST(floor(least(60000.0, 1000.0 * pow(2, least(p_size, 32))) * 0.25) AS BIGINT) AS wait, CAST(CASE WHEN p_size % 3 = 0 THEN 15000.0 ELSE least(30000.0, greatest(2000.0, p_size * 1000 * 1.5)) END AS DOUBLE) AS hedge_delay,
  abs(p_retailprice - p_retailprice * (1 + p_size * 5e-8)) <= greatest(1e-9, 1e-6 * greatest(p_retailprice, p_retailprice * (1 + p_size * 5e-8))) AS near_equal,
  greatest(1, CAST(floor(p_size * 10 / 1000 * 16000 / 270 + 0.5) AS BIGINT)) AS frames, CAST(p_size * 270 + 721 AS BIGINT) AS sample, 'sha256:' || sha256(p_name) AS fingerprint, CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE printf('%.1f', round(100.0 * p_size / (p_size % 5 * 20), 1)) || '%' END AS percent,
  (p_size * 61234) // 60000 || ':' || lpad(CAST((p_size * 61234) // 1000 % 60 AS VARCHAR), 2, '0') || '.' || (p_size * 61234) % 1000 // 100 AS elapsed,
  CASE WHEN p_size <= 10 THEN p_size * 100 || ' B' ELSE printf('%.1f', p_size * 100 / 1024.0) || ' kB' END AS bytes,
  list_sum(list_transform(range(p_size % 8), lambda k: least(8000.0, 500.0 * pow(2, k)))) IS NULL AS no_waits, coalesce(list_sum(list_transform(range(p_size % 8), lambda k: least(8000.0, 500.0 * pow(2, k)))), 0.0) AS total_wait FROM part""")
def mth_bounds_and_waits(spark, sf_dir):
    """MTH-01, 02, 03, 04, 05, 07, 09, 10, AGG-09, AGG-33, STR-26."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    odd = F.when(size % 7 == 0, F.when(size % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise((price - 950) / 50)
    ms = size * 61234
    n_bytes = size * 100
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.clamped(odd).alias("clamped"), N.band(size.cast("double"), N.DEPTH_BANDS).alias("depth_band"), N.band(size.cast("double"), N.AGE_BANDS).alias("age_band"),
        N.jitter_window(size, 1000, 60000).alias("wait_window"), N.jitter_delay(size, 1000, 60000, F.lit(0.25)).alias("wait"), N.hedge_delay(F.when(size % 3 != 0, size * 1000), 15000).alias("hedge_delay"),
        N.near(price, price * (1 + size * 5e-8)).alias("near_equal"), N.frames(size * 10, 16000, 270).alias("frames"), N.sample_of(size.cast("long"), 270, 721).alias("sample"), N.fingerprint(F.col("p_name")).alias("fingerprint"),
        N.percent(size, size % 5 * 20).alias("percent"), S.elapsed(ms).alias("elapsed"), S.byte_size(n_bytes).alias("bytes"), (size % 8 == 0).alias("no_waits"), N.total_backoff(size % 8, 500, 8000).alias("total_wait"),
    )


@query("""WITH w AS (SELECT event_id, [value / 50, CAST(event_id % 7 AS DOUBLE), CAST(user_id % 5 AS DOUBLE)] AS l FROM events)
SELECT event_id, round(1 - exp(l[1] - list_max(l)) / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 9) AS p FROM w""")
def mth_speech_probability(spark, sf_dir):
    """MTH-08."""
    logits = F.array(F.col("value") / 50, (F.col("event_id") % 7).cast("double"), (F.col("user_id") % 5).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.round(N.speech_probability(logits), 9).alias("p"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + INTERVAL (CAST(l_quantity AS INT) * 250) MILLISECOND AS at, l_shipdate > TIMESTAMP '1998-06-01' AS not_due, [CAST(l_linenumber AS INT), CAST(l_quantity AS INT), 0, 0] AS version FROM lineitem""")
def dat_due_times(spark, sf_dir):
    """DAT-02, DAT-03, MTH-11."""
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.after_ms(F.col("l_shipdate"), F.col("l_quantity") * 250).alias("at"), (F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz")).alias("not_due"), N.version_parts(version).alias("version"))


_SAYINGS = ["R-38", "1,200 cfm50", "nineteen eighty", "two hundred and five", "three thousand forty", "45%", "twenty-one point five", "about ten", "-7.5", "", "gallons", "one hundred twenty years"]
_SAID = [38.0, 1200.0, 99.0, 205.0, 3040.0, 45.0, 21.0, None, -7.5, None, None, 120.0]


@query(f"SELECT p_partkey, ({_SAYINGS})[CAST(p_partkey % {len(_SAYINGS)} AS INT) + 1] AS said, (CAST([{', '.join('NULL' if x is None else str(x) for x in _SAID)}] AS DOUBLE[]))[CAST(p_partkey % {len(_SAYINGS)} AS INT) + 1] AS number FROM part")
def str_spoken_numbers(spark, sf_dir):
    """STR-07, STR-08."""
    said = F.element_at(F.array(*map(F.lit, _SAYINGS)), (F.col("p_partkey") % len(_SAYINGS)).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), N.spoken_number(said).alias("number"))


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.join(other, ["conv_id", "turn"]).select("conv_id", "turn", S.spoken_words(F.col("text")).alias("ref_words"), S.spoken_words(F.col("hyp")).alias("hyp_words"))


_PAIRS = f"""p AS (SELECT a.conv_id, a.turn, list_filter(string_split({_SPOKEN.format("a.text")}, ' '), lambda x: x <> '') AS r, list_filter(string_split({_SPOKEN.format("b.text")}, ' '), lambda x: x <> '') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query(f"""WITH {_PAIRS}, k AS (SELECT *, len(list_filter(range(1, least(len(r), len(h)) + 1), lambda i: r[:i] = h[:i])) AS n FROM p) SELECT conv_id, turn, CAST(n AS INT) AS n_common, array_to_string(r[:n], ' ') AS common FROM k""")
def lst_common_prefix(spark, sf_dir):
    """LST-02, WIN-13 for two hypotheses."""
    t = _turns(spark, sf_dir)
    p = L.common_prefix(F.col("ref_words"), F.col("hyp_words"))
    return t.select("conv_id", "turn", F.size(p).alias("n_common"), F.array_join(p, " ").alias("common"))


#: The table of distances row by row, a step of the recursion each; each cell carries the substitutions, deletions and insertions of its way.
_WORD_ERRORS = _PAIRS.replace("p AS (", "RECURSIVE p AS MATERIALIZED (", 1) + """, h AS (SELECT conv_id, turn, unnest(range(0, len(h) + 1)) AS j, unnest(list_concat([NULL], h)) AS w FROM p),
t AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, j, w, j AS d, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS x, j AS n FROM h
UNION ALL SELECT conv_id, turn, i + 1, j, w, nd, last_value(ns IGNORE NULLS) OVER v, last_value(nx IGNORE NULLS) OVER v, last_value(nn - j IGNORE NULLS) OVER v + j
FROM (SELECT *, CASE kind WHEN 'm' THEN ds WHEN 's' THEN ds + 1 WHEN 'd' THEN s END AS ns, CASE kind WHEN 'm' THEN dx WHEN 's' THEN dx WHEN 'd' THEN x + 1 END AS nx, CASE kind WHEN 'm' THEN dn WHEN 's' THEN dn WHEN 'd' THEN n END AS nn
FROM (SELECT *, CASE WHEN j > 0 AND w = word AND nd = dd THEN 'm' WHEN j > 0 AND nd = dd + 1 THEN 's' WHEN nd = d + 1 THEN 'd' ELSE 'i' END AS kind
FROM (SELECT *, min(base - j) OVER v + j AS nd
FROM (SELECT *, CASE WHEN j = 0 THEN i + 1 ELSE least(d + 1, dd + CASE WHEN w = word THEN 0 ELSE 1 END) END AS base
FROM (SELECT t.*, p.r[t.i + 1] AS word, lag(d) OVER v AS dd, lag(s) OVER v AS ds, lag(x) OVER v AS dx, lag(n) OVER v AS dn FROM t JOIN p USING (conv_id, turn) WHERE t.i < len(p.r) WINDOW v AS (PARTITION BY t.conv_id, t.turn ORDER BY t.j)))
WINDOW v AS (PARTITION BY conv_id, turn ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))
WINDOW v AS (PARTITION BY conv_id, turn ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT t.conv_id, t.turn, s AS sub, x AS del, n AS ins, CAST(len(p.r) AS INT) AS ref_words, len(p.h) AS hyp_words FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.turn AND len(p.r) = t.i AND len(p.h) = t.j)"""


@query(f"WITH {_WORD_ERRORS} SELECT conv_id, turn, sub, del, ins, CAST(sub AS INT) AS n_pairs, ref_words, CASE WHEN ref_words > 0 THEN (sub + del + ins) / ref_words WHEN hyp_words = 0 THEN 0.0 ELSE 1.0 END AS wer FROM a")
def lst_word_errors(spark, sf_dir):
    """LST-01, MTH-12: alignment of consecutive turns; substitutions, deletions, insertions and the error rate."""
    a = L.with_alignment(_turns(spark, sf_dir))
    d = F.col("sub") + F.col("del") + F.col("ins")
    return a.select("conv_id", "turn", "sub", "del", "ins", F.size("subs").alias("n_pairs"), F.size("ref_words").alias("ref_words"), L.error_rate(d, F.col("ref_words"), F.col("hyp_words")).alias("wer"))


@query(f"WITH {_WORD_ERRORS} SELECT CAST(sum(sub + del + ins) AS BIGINT) AS errors, CAST(sum(ref_words) AS BIGINT) AS words, sum(sub + del + ins) / sum(ref_words) AS wer FROM a")
def agg_corpus_word_error(spark, sf_dir):
    """AGG-16: errors of all over words of all."""
    a = lst_word_errors(spark, sf_dir)
    return a.agg(F.sum(F.col("sub") + F.col("del") + F.col("ins")).alias("errors"), F.sum("ref_words").alias("words")).withColumn("wer", F.try_divide("errors", "words"))


@query("""SELECT doc_id, CAST(len(list_transform(range(0, greatest(length(text), 1), 1000), lambda o: substr(text, o + 1, 1000))) AS INT) AS n, md5(array_to_string(list_transform(range(0, greatest(length(text), 1), 1000), lambda o: substr(text, o + 1, 1000)), '|')) AS parts FROM documents""")
def lst_slices(spark, sf_dir):
    """LST-22."""
    parts = L.slices(F.col("text"), 1000)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("parts"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL (CAST(o_orderkey AS INT) % 1000) MILLISECOND, '%Y-%m-%dT%H:%M:%S.%gZ') AS ordered, true AS now_is_later FROM orders")
def dat_iso_instants(spark, sf_dir):
    """DAT-01: instants as ISO 8601, whose order is that of time, and the present one."""
    at = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000)
    ordered = N.iso_instant(at)
    return table(spark, sf_dir, "orders").select("o_orderkey", ordered.alias("ordered"), (N.iso_instant() > ordered).alias("now_is_later"))
