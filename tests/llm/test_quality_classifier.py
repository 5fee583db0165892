import math

import numpy as np
import pyarrow as pa

from attestra.llm import quality_classifier as Q
from attestra.llm.quality_classifier import FEATURES, fit, with_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = with_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    right = [r.predicted == r.quality for r in got]
    assert sum(right) / len(right) > 0.93
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words", "x"), (3, "w " * 50_000, "x"), (3, "w " * 50_000, "x"), (4, "é" * 9999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = with_quality(docs, labels).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert with_quality(docs.limit(0), labels).collect() == []
    assert {r.score for r in with_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_attention_finds_the_telling_passage():
    rnd = np.random.default_rng(0)
    sizes = rnd.integers(1, 9, 400)
    y = rnd.integers(0, 2, 400).astype(float)
    x = rnd.normal(0, 0.1, (sizes.sum(), 44)).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    tell = starts + rnd.integers(0, sizes)
    x[tell[y == 0], 3] += 2
    model = fit(x, sizes, y)
    r = model.run(x, starts, sizes)
    assert ((r["s"] > 0.5) == y).mean() > 0.97
    many = (y == 0) & (sizes > 3)
    assert r["a"][tell[many]].mean() > 1.5 / sizes[many].mean()


def test_labels_that_disagree_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, ("plain words of a text. " if i % 2 else "BUY!!! $$$ ") * 20) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    odd = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 40, 4)], "doc_id long, quality int")
    scores = lambda x: {r.doc_id: r.score for r in with_quality(docs, x).collect()}
    clean = labels.join(odd, "doc_id", "left_anti")
    assert scores(labels.union(odd)) == scores(clean)


def test_forward_pass_matches_plain_python():
    rnd = np.random.default_rng(3)
    sizes, y = np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    x = rnd.normal(0, 1, (9, FEATURES)).astype(np.float32)
    model = fit(x, sizes, y, steps=20)
    got = model.run(x, np.cumsum(sizes) - sizes, sizes)["s"]
    p = {k: np.asarray(v, float) for k, v in model.parts.items()}
    at = 0
    for i, n in enumerate(sizes):
        hidden, energy = [], []
        for row in x[at : at + n]:
            v = [min(max((float(row[f]) - float(model.shift[f])) / float(model.scale[f]), -8), 8) for f in range(FEATURES)]
            h = [math.tanh(sum(v[f] * p["W"][f, j] for f in range(FEATURES)) + p["b"][j]) for j in range(len(p["b"]))]
            gate = lambda k, h=h: math.tanh(sum(a * b for a, b in zip(h, p["V"][:, k], strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, k], strict=True))))
            hidden.append(h)
            energy.append(math.exp(sum(gate(k) * p["w"][k] for k in range(len(p["w"])))))
        z = [sum(e * h[j] for e, h in zip(energy, hidden, strict=True)) / sum(energy) for j in range(len(p["b"]))]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - float(p["d"])))
        assert abs(got[i] - want) < 1e-4
        at += n


def test_long_texts_are_learnt_whole(spark):
    # what tells stands in the last words only, far beyond the first passages
    docs = spark.createDataFrame([(i, "some plain words stand here. " * 900 + ("BUY NOW!!! $$$ " * 30 if i % 2 else "and these end it. " * 30)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    got = with_quality(docs, labels).where("held_out").collect()
    assert got and all((r.score > 0.5) == (r.doc_id % 2 == 0) for r in got)


def test_columns_of_other_case_and_repeated_ids(spark):
    rows = [(i, ("plain words of a text. " if i % 2 else "BUY!!! $$$ ") * 20, "x", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string, HELD_OUT int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = with_quality(docs, labels)
    assert once.columns == ["doc_id", "text", "score", "held_out", "predicted"]
    many = docs.union(spark.range(3000).selectExpr("1L AS doc_id", "'plain words of a text' AS text", "'y' AS Score", "1 AS HELD_OUT"))
    assert {r.doc_id: r.score for r in with_quality(docs.union(docs), labels).collect()} == {r.doc_id: r.score for r in once.collect()}
    assert with_quality(many, labels).count() == 3040


def test_encoder_matches_plain_python():
    texts = ["Plain words, and ONE more! 12 plain words, and one. " * 9, "", None, "é Über né... $$$ a A1 xyz", "same same same same same", "x" * 50]
    white = " \t\n\v\f\r"

    def plain(text):
        words = [w for w in "".join(" " if c in white else c for c in text or "").split(" ") if w]
        raw = [w.encode() for w in words]
        upper, digit, high = (lambda b: 65 <= b <= 90), (lambda b: 48 <= b <= 57), (lambda b: b >= 128)
        letter = lambda b: upper(b) or 97 <= b <= 122 or high(b)
        seen, windows, rows = set(), set(), []
        for k, w in enumerate(raw):
            n_up, n_let, n_dig = sum(map(upper, w)), sum(map(letter, w)), sum(map(digit, w))
            last = 0 if letter(w[-1]) else 1 if w[-1] in b".,;:?!" else 2 if digit(w[-1]) else 3
            first = 0 if 97 <= w[0] <= 122 or high(w[0]) else 1 if upper(w[0]) else 2 if digit(w[0]) else 3
            window = tuple(raw[k : k + 3]) if k + 3 <= len(raw) else None
            rows.append(([n_up >= 2 and n_up == n_let, len(w) <= 4 and n_let == len(w), w[-1] in b".,;:?!" and len(w) > 1, last == 3, w[-1:] == b"!", n_dig > 0, high(w[0]) or high(w[-1]), min(len(w), 40) / 10, w in seen, window is not None and window in windows], first * 8 + last * 2 + (len(w) > 3)))
            seen.add(w)
            windows.add(window)
        out = []
        for p in range(max(1, -(-len(rows) // Q.PASSAGE))):
            part = rows[p * Q.PASSAGE : (p + 1) * Q.PASSAGE]
            n = max(len(part), 1)
            shapes = [sum(s == j for _, s in part) / n for j in range(Q.SHAPES)]
            out.append([*(sum(f[j] for f, _ in part) / n for j in range(10)), len(part) / Q.PASSAGE, math.log1p(len(rows)) / 5, *shapes])
        return out

    at = 0
    for chunk in Q.chunks(pa.array(texts)):
        x, sizes = Q.encoded(chunk)
        for i, n in enumerate(sizes):
            want = np.array(plain(texts[chunk.first + i]))
            assert want.shape == (n, FEATURES) and np.allclose(x[at : at + n], want, atol=1e-5)
            at += n
    assert at == sum(len(plain(t)) for t in texts)


def test_gradient_matches_finite_differences():
    rnd = np.random.default_rng(4)
    sizes, y = np.array([3, 1, 4, 2]), np.array([1.0, 0.0, 0.0, 1.0])
    x = rnd.normal(0, 1, (10, FEATURES))
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(4), sizes)
    at = fit(x, sizes, y, steps=0)
    parts = {k: np.array(np.asarray(v, float) + rnd.normal(0, 0.3, np.shape(v))) for k, v in at.parts.items()}

    def loss(parts):
        s = Q.Model(at.shift, at.scale, parts).run(x, starts, sizes)["s"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    slopes = Q.Model(at.shift, at.scale, parts).slopes(x, starts, sizes, doc, y)
    for name, value in parts.items():
        for k in rnd.choice(value.size, min(value.size, 12), replace=False):
            up, down = ({**parts, name: value.copy()} for _ in range(2))
            up[name].flat[k] += 1e-5
            down[name].flat[k] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - np.asarray(slopes[name]).flat[k]) < 1e-6, (name, k)
