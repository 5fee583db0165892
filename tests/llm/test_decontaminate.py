import random
import re

import pytest

from attestra.llm.decontaminate import decontaminate, digest, without_contamination

RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return RE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(str(k))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("shortest,block", [(1, 400_000), (4, 400_000), (12, 400_000), (3, 2)])
def test_matches_brute_force(spark, shortest, block):
    rnd = random.Random(shortest)
    some = lambda n: " ".join(rnd.choice(["a", "B", "c", "é", "d1"]) for _ in range(n))
    items = [(k, some(rnd.randint(shortest, 25))) for k in range(8)] + [(98, None), (99, "... !!"), (100, "a a a a a a a a a a a a")]
    docs = [(i, some(rnd.randint(0, 60)) + rnd.choice(["", ". " + items[i % 8][1].upper().replace(" ", "--")])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "a " * 3000), (103, items[0][1])]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate(d, b, block).collect()}
    assert got == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    full = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None)], docs)
    assert decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    assert sorted(r.n_words for r in digest(decontaminate(full, spark.createDataFrame([], items))).collect()) == [0, 2, 2]


def test_cutting(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Clean. {item}! the rest stays " + "x " * 30, 5), (2, item, 5), (3, "clean", 5), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for block in (400_000, 1):
        items = spark.createDataFrame([(1, item), (2, "zz yy xx ww vv uu tt ss rr qq pp")], "item_id long, text string")
        got = {r.doc_id: r for r in without_contamination(docs, items, block_words=block).collect()}
        assert set(got) == {1, 3, 4} and got[3].text == "clean" and got[4].text is None
        assert got[1].text.startswith("Clean.  ! the rest stays") and got[1].n_chars == len(got[1].text)
