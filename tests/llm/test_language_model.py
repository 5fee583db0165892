import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from attestra.llm import language_model
from attestra.llm.language_model import BUCKETS, CLASSES, LEAST_ROWS, MOST_ROWS, ROUNDS, WIDTH, Model, Tokens, _tokenize, _train, held_out, language_model_scores, places, table_rows
from attestra.llm.language_model import ROWS as TABLE_ROWS


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def brute(docs):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(t for i, x in docs if not out(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in docs:
        w = tokens(x)
        yield i, out(i), len(w), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string")
    got = language_model_scores(frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    want = sorted(brute(docs), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    return got


def test_base_matches_brute_force(spark):
    docs = [(i, " ".join(["The", f"w{i % 5}", "É", "x" * (i % 40), "\n\t", "end"] * (i % 9))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "one " * 40_000), (100, None), (None, "no id"), (5, "again")]
    got = check(spark, docs)
    assert all(g[6] < 0 for g in got)
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert language_model_scores(frame).count() == 0


def test_held_out_text_is_likelier_than_by_the_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [g for g in check(spark, docs) if g[1]]
    base, score, n = (sum(g[k] for g in got) for k in (5, 6, 2))
    assert score > base + 0.03 * n


def test_probabilities_sum_to_one():
    rnd = np.random.default_rng(1)
    frequent = np.sort(rnd.integers(0, 2**63, 900).astype(np.uint64))
    mass = rnd.random((CLASSES, WIDTH))
    model = Model(1000, 900, frequent, rnd.permutation(900), np.full(BUCKETS, 7), [rnd.normal(0, 1, (TABLE_ROWS, WIDTH)).astype(np.float32) for _ in range(2)], np.log(mass.sum(1)), np.log(mass))
    row = {"vocabulary": frequent[:3].tobytes(), "bounds": np.array([0, 4], "<i8").tobytes(), "tokens": np.array([0, 1, 2, 0], "<u2").tobytes()}
    rows = Tokens(row).features(np.array([3]))
    total = 0.0
    top = np.exp(model.log_softmax(0, rows, None))[0]
    for c in range(CLASSES):
        classes = np.array([c])
        total += top[c] * np.exp(model.log_softmax(1, model.inner_rows(rows, classes), classes))[0].sum()
    assert abs(total - 1) < 1e-5


def test_every_token_is_learnt_once():
    for rounds in (1, 3, 5):
        for chunk, n in ((-7, 5), (0, 1), (12, 100)):
            at = np.concatenate([places(chunk, turn, rounds, n) for turn in range(rounds)])
            assert sorted(at.tolist()) == list(range(n))


def test_rounds_learn_every_token(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"a{i} b c") for i in range(40)], "doc_id long, text string")
    learnt = []
    learn = Model.learn

    def counted(self, tokens, at, *more):
        learnt.append(len(at))
        return learn(self, tokens, at, *more)

    monkeypatch.setattr(Model, "learn", counted)
    train = frame.where(~held_out()).select("doc_id", "text", held_out().alias("held_out"))
    rows = pa.RecordBatch.from_pandas(train.toPandas())
    table = [pa.RecordBatch.from_pylist(x.to_pylist(), x.schema) for x in _tokenize([rows])]
    model = Model(1, 1, np.zeros(0, np.uint64), np.zeros(0, int), np.ones(BUCKETS), [np.zeros((TABLE_ROWS, WIDTH), np.float32) for _ in range(2)], np.zeros(CLASSES, np.float32), np.zeros((CLASSES, WIDTH), np.float32))
    for turn in range(ROUNDS):
        list(_train(table, model, turn, ROUNDS))
    assert sum(learnt) == 4 * train.count()


def test_repeated_tables_and_equal_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    one = {(r.doc_id, r.n_tokens): r for r in language_model_scores(docs).collect()}
    docs.write.parquet(str(tmp_path / "a"))
    same = spark.read.parquet(*[str(tmp_path / "a")] * 2)
    for table in (docs.union(docs), same):
        got = language_model_scores(table).collect()
        assert len(got) == 120
        for r in got:
            assert (r.doc_id, r.n_tokens) in one and r.train_tokens == 2 * one[r.doc_id, r.n_tokens].train_tokens


def test_tables_grow_with_the_corpus():
    assert [table_rows(n) for n in (0, 10, 1 << 26, 1 << 30, 1 << 50)] == [LEAST_ROWS, LEAST_ROWS, 1 << 13, 1 << 15, MOST_ROWS]


def test_counts_of_tokens_beyond_the_common_ones(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COMMON", 3)
    check(spark, [(i, " ".join(["the", "of", f"w{i % 5}", f"v{i}"] * (i % 7))) for i in range(80)])


def test_score_matches_a_plain_softmax():
    rnd = np.random.default_rng(4)
    vocabulary = rnd.integers(0, 2**63, 30).astype(np.uint64)
    frequent, at = np.sort(vocabulary[:20]), rnd.permutation(20)
    mass = rnd.random((CLASSES, WIDTH))
    model = Model(1000, 30, frequent, at, np.full(BUCKETS, 9), [rnd.normal(0, 1, (TABLE_ROWS, WIDTH)).astype(np.float32) for _ in range(2)], np.log(mass.sum(1)), np.log(mass))
    line = rnd.integers(0, 30, 50)
    row = Tokens({"vocabulary": vocabulary.tobytes(), "bounds": np.array([0, 20, 50], "<i8").tobytes(), "tokens": line.astype("<u2").tobytes()})
    counts = rnd.integers(0, 5, 30)
    got = model.score(row, counts)[1]
    for k, word in enumerate(line.tolist()):
        rows = row.features(np.array([k]))
        known = np.flatnonzero(frequent == vocabulary[word])
        outcome = int(at[known[0]]) if len(known) else CLASSES * WIDTH - BUCKETS + int(vocabulary[word] % np.uint64(BUCKETS))
        c, o = divmod(outcome, WIDTH)
        share = lambda z, x: math.exp(z[x]) / sum(math.exp(v) for v in z)
        first = [sum(float(model.weights[0][r][x]) for r in rows[0]) + float(model.classes_bias[x]) for x in range(CLASSES)]
        inner = model.inner_rows(rows, np.array([c]))[0]
        second = [sum(float(model.weights[1][r][x]) for r in inner) + float(model.outcome_bias[c][x]) for x in range(WIDTH)]
        p = share(first, c) * share(second, o) * (1 if len(known) else (counts[word] + 1) / 9)
        assert abs(got[k] - math.log10(p)) < 1e-3
