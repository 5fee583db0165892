import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.functions import strings as S
from attestra.functions import structures as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(x):
    return F.lit(x).cast("string")


def test_grounding_and_verbatim_differ_on_blank_quotes(spark):
    text = lit("He said: it leaks.")
    assert one(spark, S.is_grounded(lit("it leaks. \n"), text)) and not one(spark, S.is_grounded(lit("  "), text)) and not one(spark, S.is_grounded(lit(None), text))
    assert one(spark, S.is_verbatim(lit("  "), text)) and not one(spark, S.is_verbatim(lit(""), text)) and not one(spark, S.is_verbatim(lit("It leaks"), text))


@pytest.mark.parametrize("span,want", [
    ("the furnace is", "verbatim"), ("The  Furnace is", "near-miss"), ("the furnace, is new", "near-miss"), ("um the furnace is new and then", "near-miss"), ("the boiler is old", "fabricated"), ("", "fabricated"), (None, "fabricated"),
])
def test_span_classes(spark, span, want):
    assert one(spark, S.span_class(lit(span), lit("So the furnace is new, they say."))) == want


def test_labels(spark):
    label = lambda p: one(spark, S.leaf_label(lit(p)))
    assert [label(p) for p in ("attic.atticInsulationDepth", "health.healthGasLeak", "base.yearBuilt", "dhw.dhwType2", "plain")] == ["Insulation depth", "Gas leak", "Year built", "Type 2", "Plain"]
    assert one(spark, S.member_slug(lit('6% - Well "sealed" (12")'))) == "well_sealed_12"
    assert one(spark, S.escaped(lit('a<b & "c" {{x}}'))) == "a&lt;b &amp; &quot;c&quot; &#123;&#123;x&#125;&#125;"


def test_packed(spark):
    parts = F.array(*map(F.lit, ["a b c", "d e", "f", "g h i j k l", "m"]))
    assert one(spark, S.packed(parts, 5)) == ["a b c d e", "f", "g h i j k l", "m"]
    assert one(spark, S.packed(F.array().cast("array<string>"), 5)) == []


def test_chunk_names_sort_and_overflow(spark):
    assert one(spark, S.chunk_name(lit("s"), F.lit(7), F.lit(3))) == "audio-s-000007-03"
    with pytest.raises(Exception, match="out of range"):
        one(spark, S.chunk_name(lit("s"), F.lit(1_000_000), F.lit(0)))


@pytest.mark.parametrize("said,want", [("R-38", 38.0), ("two hundred and five", 205.0), ("nineteen eighty", 99.0), ("twenty-one point five", 21.0), ("1,200 CFM50", 1200.0), ("about ten", None), ("", None), (None, None), ("thousand", 1000.0), ("and", None)])
def test_spoken_numbers(spark, said, want):
    assert one(spark, N.spoken_number(lit(said))) == want


def test_bands_and_bounds(spark):
    band = lambda x: one(spark, N.band(F.lit(x).cast("double"), N.DEPTH_BANDS))
    assert [band(x) for x in (0, 0.5, 3, 3.5, 15, 15.1, None)] == ["0", "1-3", "1-3", "4-6", "13-15", "16+", None]
    for bad in (-1, float("inf"), float("nan")):
        with pytest.raises(Exception, match="out of range"):
            band(bad)
    assert [one(spark, N.clamped(F.lit(x).cast("double"))) for x in (1.4, -0.1, 0.3, float("nan"), float("-inf"), None)] == [1.0, 0.0, 0.3, 0.0, 0.0, 0.0]


def test_waits(spark):
    assert N.most_retries(budget_ms=10_000, attempt_ms=2000, base_ms=1000, cap_ms=8000) == 2
    assert one(spark, N.total_backoff(F.lit(5), 500, 2000)) == 500 + 1000 + 2000 * 3
    assert one(spark, N.jitter_window(F.lit(100), 1000, 1e30)) == 1000 * 2.0**32


def edit_table(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def test_alignment_matches_the_edit_distance(spark):
    rnd = random.Random(6)
    pairs = [([rnd.choice("abc") for _ in range(rnd.randint(0, 9))], [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]) for _ in range(60)]
    frame = spark.createDataFrame(pairs, "ref_words array<string>, hyp_words array<string>")
    for r in L.with_alignment(frame.withColumn("d", L.word_distance(F.col("ref_words"), F.col("hyp_words")))).collect():
        want = edit_table(r.ref_words, r.hyp_words)
        assert r.d == r["sub"] + r["del"] + r["ins"] == want and len(r.subs) == r["sub"] and all(x.ref != x.hyp for x in r.subs)
        assert r["del"] - r["ins"] == len(r.ref_words) - len(r.hyp_words)


def test_common_prefixes(spark):
    a, b, c = (F.split(F.lit(x), " ") for x in ("a b c d", "a b x", "a b c"))
    assert one(spark, L.common_prefix(a, b)) == ["a", "b"] and one(spark, L.common_prefix(a, c)) == ["a", "b", "c"]
    assert one(spark, L.common_prefix_of(F.array(a, b, c))) == ["a", "b"]


def test_white_space_of_all_kinds(spark):
    white = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
    rows = [f"{w}A{w}{w} ‘b’{w}c-d’s{w}" for w in white] + ["", white, "a\u200bb\ufeff", "x\x1cy"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", S.loose_text(F.col("t")).alias("loose"), S.spoken_text(F.col("t")).alias("spoken"), S.right_trimmed(F.col("t")).alias("cut")).collect()
    for r in got:
        straight = r.t.lower().replace("‘", "'").replace("’", "'")
        assert r.loose == re.sub(f"[{white}]+", " ", straight).strip(" ")
        assert r.spoken == re.sub("[^a-z0-9']+", " ", straight).strip(" ")
        assert r.cut == r.t.rstrip(white)


def test_alignment_is_the_same_with_and_without_the_whole_table(monkeypatch):
    rnd = random.Random(4)
    pairs = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 40))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 40))]) for _ in range(200)]
    whole = [L._aligned(*p) for p in pairs]
    monkeypatch.setattr(L, "WHOLE", -1)
    assert [L._aligned(*p) for p in pairs] == whole
