import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestra.llm import toxicity as T
from attestra.llm.text_arrays import chunks


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = T.with_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    share = lambda y: np.mean([r.predicted for r in got if r.toxic == y])
    assert share(1) > 0.9 and share(0) < 0.06 and all(0 <= r.score <= 1 for r in got)


def test_features_match_plain_python():
    texts = ["Réeuxpa, idiot! IDIOT--idiots", "", None, "a bcd 12345678901 é", "x" * 30]
    want = []
    for text in texts:
        words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
        want.append({("whole", w) for w in words} | {(k, w[:k]) for w in words for k in T.BEGINNINGS if len(w) >= k})
    got = [set() for _ in texts]
    for chunk in chunks(pa.array(texts)):
        for d, b in zip(*T.features(chunk), strict=True):
            got[d + chunk.first].add(b)
    assert [len(x) for x in got] == [len(x) for x in want]
    for a in range(len(texts)):  # equal features share buckets, others don't
        for b in range(len(texts)):
            assert len(got[a] & got[b]) == len(want[a] & want[b])


def test_gradient_matches_finite_differences():
    rnd = np.random.default_rng(1)
    z, positive = rnd.normal(0, 1, 12), np.arange(12) < 5
    toxic, clean, to_toxic, to_clean = T._risks(z, positive, 0.2)
    for k in range(12):
        moved = z.copy()
        moved[k] += 1e-6
        t, c, _, _ = T._risks(moved, positive, 0.2)
        assert abs((t - toxic) / 1e-6 - to_toxic[k]) < 1e-5 and abs((c - clean) / 1e-6 - to_clean[k]) < 1e-5
    soft = lambda x: np.log1p(np.exp(x))
    assert np.isclose(toxic, 0.2 * soft(-z[:5]).mean()) and np.isclose(clean, soft(z[5:]).mean() - 0.2 * soft(z[:5]).mean())


def test_risk_of_the_others_stays_above_zero():
    """Enough features to tell every confirmed document apart: without the correction the risk would run below zero."""
    rnd = np.random.default_rng(2)
    n_p, n_u, f = 60, 300, 400
    toxic = np.concatenate([np.ones(n_p, bool), rnd.random(n_u) < 0.3])
    x = rnd.random((n_p + n_u, f)) < np.where(toxic[:, None] & (np.arange(f) < 3), 0.8, 0.05)
    docs, columns = np.nonzero(x)
    positive = np.arange(n_p + n_u) < n_p
    w, bias = T.fit(docs, columns, f, positive, 0.3)
    z = x @ w + bias
    assert T._risks(z, positive, 0.3)[1] > -0.05
    u = ~positive
    assert z[u & toxic].mean() > z[u & ~toxic].mean() + 1


def test_odd_rows(spark):
    said = lambda k: "you idiot, what trash " if k % 3 == 0 else "a quiet day by the sea "
    rows = [(k, f"{said(k)} word{k % 7} " * 5, "x", 9) for k in range(240)] + [(None, said(0), None, 9), (500, None, "x", 9), (501, "", "x", 9), (1, said(0) * 100_000, "x", 9), (2, said(1) * 50, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string, `held_out x` int")
    labels = spark.createDataFrame([(k, 1 if k % 3 == 0 else 0) for k in range(0, 240, 2)] + [(None, 1), (4, None), (6, 0)], "doc_id long, toxic int")
    got = T.with_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "held_out x", "held_out", "score", "predicted"}
    for r in got:
        assert r.predicted == int("idiot" in (r.text or "")), r
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
    assert len({r.score for r in got if not r.text}) == 1
    twice = T.with_toxicity(docs.union(docs), labels)
    assert {(r.doc_id, r.score) for r in twice.collect()} == {(r.doc_id, r.score) for r in got}
    assert T.with_toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in T.with_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    only = T.with_toxicity(docs, labels.where("toxic = 1")).where(F.col("text").contains("idiot") & (F.col("predicted") == 0))
    assert only.isEmpty()
