import random

import numpy as np

from attestra.llm.components import components
from attestra.llm.near_duplicates import Shingles, near_duplicates, prob_min_hash, without_near_duplicates
from attestra.llm.text_arrays import Chunk


def words(text):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Class of each document by all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for group in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 30, 120, 300]))]
        for _ in range(rnd.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append(" ".join(copy))
        docs.append(" ".join(base))
    rnd.shuffle(docs)
    return list(enumerate(docs)) + [(900, None), (901, ""), (902, "  \n"), (903, "w1 " * 30_000), (904, "w1 " * 30_000)]


def test_classes_match_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, class_id string")
    assert {r.doc_id: r.class_id for r in near_duplicates(frame).collect()} == brute(docs)
    kept = sorted(r.doc_id for r in without_near_duplicates(frame).collect())
    assert kept == sorted(set(brute(docs).values()))


def test_registers_estimate_probability_jaccard():
    a = [f"a{k}" for k in range(300)]
    texts = [" ".join(a), " ".join(a[:270] + [f"b{k}" for k in range(30)])]
    data = "".join(texts).encode()
    sets = Shingles(Chunk(np.frombuffer(data, np.uint8), np.array([0, len(texts[0].encode()), len(data)])))
    got = prob_min_hash(sets, 4096)
    x, y = shingles(texts[0]), shingles(texts[1])
    assert abs((got[0] == got[1]).mean() - len(x & y) / len(x | y)) < 0.03


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id) for r in near_duplicates(docs).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id or 0 for r in without_near_duplicates(docs).collect()) == [0, 1, 3]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_copies_with_repeated_passages_are_found(spark):
    docs, size = [], 104
    for k in range(40):
        base = [f"d{k}w{i}" for i in range(size)]
        copy = base[:60] + base[40:60] * 300 + base[60:-9] + [f"d{k}n{i}" for i in range(9)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    x, y = shingles(docs[0][1]), shingles(docs[1][1])
    assert 0.8 <= len(x & y) / len(x | y) < 0.81
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in docs}


def test_a_bucket_of_many_that_are_apart(spark):
    """A third of the documents share a long passage and little else; a few have near copies."""
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(200)]
    docs = []
    for k in range(240):
        own = [f"d{k}w{i}" for i in range(60)]
        text = passage + own if k % 3 == 0 else own * 2
        docs.append((k, " ".join(text)))
        if k % 12 == 0:
            own[rnd.randrange(60)] = "changed"
            docs.append((1000 + k, " ".join(passage[:190] + own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(frame).collect()} == brute(docs)


def test_components_of_a_block_are_linked_once(spark):
    """Near copies in a bucket of others: as many tables are written as the steps need, and blocks of several rows and columns find all."""
    import attestra.llm.components as c
    import attestra.llm.near_duplicates as n

    rnd, docs = random.Random(6), []
    passage = [f"p{k}" for k in range(150)]
    for k in range(330):
        own = [f"d{k}w{i}" for i in range(60)]
        docs.append((2 * k, " ".join(passage + own)))
        own[rnd.randrange(5, 55)] = "changed"
        docs.append((2 * k + 1, " ".join(passage + own)))
    made, write = [], n.written

    def noted(df, *a):
        made.append(df.columns)
        return write(df, *a)

    n.written = c.written = noted
    try:
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        n.written = c.written = write
    assert got == {i: i // 2 * 2 for i, _ in docs}
    assert len([x for x in made if x != ["node", "old", "component"]]) <= 14  # beside the rounds of components
