import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attestra.llm.fill_in_middle import boundaries, cut, fill_in_middle, ranked, restored

ODD = [None, "", "a", "é", "<P>", "x<M>y", "<", "<<S", "S>", "M>\n", " \t ", "😀" * 3, "né à 😀\n\nzz ", "P>" * 50, "ab<" * 80]


def plain(doc_id, text, seed=1):
    """The contract, character by character."""
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_ranked_bits_match_a_walk():
    rnd = random.Random(1)
    for width in (1, 5, 63, 64, 65, 200, 1000):
        mask = rnd.getrandbits(width) | 1
        places = [i for i in range(width) if mask >> i & 1]
        assert [ranked(mask, k, width) for k in range(len(places))] == places


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_units_match_plain_python(unit):
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab é😀\n\t ") for _ in range(rnd.randint(0, 150)))
        starts = {
            "character": list(range(len(text))),
            "word": [i for i, c in enumerate(text) if not c.isspace() and (i == 0 or text[i - 1].isspace())],
            "line": [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"],
        }[unit]
        data = text.encode()
        mask = boundaries(data, unit)
        assert mask.bit_count() == len(starts)
        for k in range(len(starts) + 1):
            want = 0 if k == 0 else len(text) if k == len(starts) else starts[k]
            assert data[: cut(data, mask, len(starts), k)].decode() == text[:want]


def test_outputs_match_plain_python_and_go_back(spark):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("ab<>PSM é😀\n") for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((i, *plain(i, t))), t or "") for i, t in rows)
    assert sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_units_go_back(spark):
    docs = spark.createDataFrame([(k, "one two\nthree  four é\n" * k) for k in range(1, 60)], "doc_id long, text string")
    for unit in ("word", "line"):
        got = fill_in_middle(docs, unit=unit).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert {r.doc_id: r.back for r in got} == {r.doc_id: r.text for r in docs.collect()}


def test_long_text_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "né " * 400_000, "x", 7)], "doc_id long, text string, output string, key int")
    got = fill_in_middle(docs, plain_from=100).collect()
    assert got[0].n == 1_200_000 and got[0].key == 7 and got[0].output == plain(1, "né " * 400_000)[4]
    assert fill_in_middle(docs.limit(0)).collect() == []
