import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import repeated_spans
from attestra.llm.repeated_spans import without_repeated_spans
from attestra.llm.suffix_order import ranks


def brute(docs, width=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def run(spark, docs, **more):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, kept string").repartition(3)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in without_repeated_spans(frame, **more).collect())


def test_ranks_are_those_of_sorted_strings():
    rnd = random.Random(1)
    data = np.frombuffer("".join(rnd.choice("ab\x00") for _ in range(400)).encode() * 2 + b"a" * 200, np.uint8)
    starts = np.array([rnd.randrange(len(data)) for _ in range(500)])
    lengths = np.array([rnd.randint(0, min(80, len(data) - s)) for s in starts])
    strings = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    order = sorted(strings)
    assert ranks(data, starts, lengths).tolist() == [order.index(s) for s in strings]


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    parts = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(10, 160))) for _ in range(14)]
    docs = []
    for i in range(90):
        t = "".join(rnd.choice(parts)[rnd.randint(0, 5) :] if rnd.random() < 0.7 else "".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 9)))
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, docs[3][1]), (203, docs[3][1]), (204, "a" * 49), (205, "a" * 49), (206, "a" * 3000), (207, "b" + "a" * 700 + "c"), (208, "abc" * 500), (209, "ab" * 500), (-5, docs[7][1] + "tail")]
    rnd.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_long_documents_and_repeats(spark):
    rnd = random.Random(5)
    long_ = "".join(rnd.choice("abcdefghij ") for _ in range(60_000))
    docs = [(5, long_), (5, long_), (9, "x" + long_[1000:2000] + "y" + long_[1040:1080]), (2, long_[:30_000])]
    assert run(spark, docs) == brute(docs)


def test_odd_rows(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from it"
    docs = spark.createDataFrame([(None, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in without_repeated_spans(docs).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (2, len(t))]
    assert without_repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share,fan", [(1, 1), (2, 2), (5, 4096), (10**6, 1)])
def test_split_hashes_match_brute_force(spark, share, fan):
    """Nearly every hash, or those of some runs, is split into shares; chunks meet one by one, two by two or all at once."""
    rnd = random.Random(share)
    phrase = "this very common line stands in a third of all the documents there are"
    some = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    docs = [(i, some(rnd.randint(0, 60)) + (phrase if i % 3 == 0 else "") + some(rnd.randint(0, 60)) + ("z" * 90 if i % 7 == 0 else "")) for i in range(60)]
    docs += [(200, None), (201, ""), (202, docs[3][1]), (203, docs[3][1]), (203, docs[3][1]), (-5, docs[9][1])]
    assert run(spark, docs, share=share, fan=fan) == brute(docs)


def test_a_line_in_a_third_of_many_chunks(spark):
    """Each document is a chunk of its own row here; the line's hash is split, and its strings reduced two chunks at a time."""
    rnd = random.Random(9)
    line = "Licensed to whom it may concern, in every third document of this table."
    docs = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(70)) + (line[: 50 + i % 20] if i % 3 == 0 else "")) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in without_repeated_spans(frame, share=3, fan=2).collect())
    assert got == brute(docs)


def chunk_rows(docs, per_batch):
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in x], pa.int64()), "text": pa.array([t for _, t in x])}) for x in (docs[k : k + per_batch] for k in range(0, len(docs), per_batch))]
    return [r for b in repeated_spans._chunk_rows(iter(batches)) for r in b.to_pylist()]


def test_a_chunk_is_large_whatever_the_batches():
    """Each chunk sends a row to each part: were chunks as small as batches, these rows would grow with the square of the input."""
    rnd = random.Random(4)
    docs = [(i, "".join(rnd.choice("abcdefgh é") for _ in range(40)) * rnd.randint(0, 9000)) for i in range(120)] + [(None, None), (7, "")]
    rows = chunk_rows(docs, 5)
    total = sum(len((t or "").encode()) for _, t in docs)
    assert len(rows) <= -(-total // (repeated_spans.CHUNK - repeated_spans.PIECE)) < total / repeated_spans.PIECE / 4
    back = []
    for r in rows:
        data, cut = repeated_spans.unpacked(r["data"]).tobytes(), repeated_spans.unpacked(r["offsets"], "<i8").tolist()
        assert r["n_bytes"] == len(data) == cut[-1]
        back += [(i, data[a:b]) for i, a, b in zip(r["ids"], cut[:-1], cut[1:], strict=True)]
    assert back == [(i, (t or "").encode()) for i, t in docs]


def test_runs_are_the_same_in_pieces(monkeypatch):
    rnd = random.Random(6)
    docs = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 3, 49, 50, 51, 400])))) for i in range(80)]
    row = chunk_rows(docs, 80)[0]
    whole = repeated_spans.Runs(row["data"], row["offsets"])
    assert len(whole.hash)
    for piece in (1, 60, 1000):
        monkeypatch.setattr(repeated_spans, "PIECE", piece)
        runs = repeated_spans.Runs(row["data"], row["offsets"])
        for name in ("hash", "first", "count", "doc"):
            assert getattr(runs, name).tolist() == getattr(whole, name).tolist()


def test_ranks_of_strings_that_differ_late_or_not_at_all():
    rnd = random.Random(2)
    start = b"x" * 45
    strings = [start + b"y" * rnd.choice([0, 3, 60, 61, 300]) + rnd.choice([b"", b"a", b"\x00", b"b" * 9]) for _ in range(300)]
    strings += [start + b"same" * 40] * 3 + [b"z" * 50] * 4
    data, cut = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    order = sorted(strings)
    assert ranks(data, cut[:-1], np.diff(cut)).tolist() == [order.index(s) for s in strings]
