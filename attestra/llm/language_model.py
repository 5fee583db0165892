"""A hashed maximum-entropy language model over all documents.

Documents become rows of whole chunks: the chunk's distinct token hashes, and the tokens as numbers of those. Spark counts every training token over the corpus; the most frequent ones, of fixed number, go to every task, and an exchange by hash sends each chunk the counts of its other tokens. The model predicts a token's outcome, one of the most frequent words or a bucket of all others, as class and outcome within the class: two softmaxes over hashed features of the tokens before (two n-grams, two skips), in tables whose rows grow with the square root of the corpus. Within a bucket a word has its share of the bucket's training tokens. Tasks learn on their own chunks from the same start, and Spark averages what they learnt, round after round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches, row_names, written
from attestra.llm.text_arrays import Chunk, chunks, joined, mix

#: Classes, outcomes of each, and how many of the last outcomes are buckets of rare words.
CLASSES, WIDTH, BUCKETS = 32, 32, 64
#: Rows of each hashed weight table: the power of two nearest to the root of the training tokens, from LEAST_ROWS to MOST_ROWS, which bounds what is broadcast; ROWS where nothing is said.
LEAST_ROWS, ROWS, MOST_ROWS = 1 << 12, 1 << 13, 1 << 16
#: Rounds of averaging: of as many neighbouring tokens each gives its gradient in another round. Rows of a block in which weights are exchanged.
ROUNDS, BLOCK = 3, 256
#: The most frequent tokens whose counts go to every task.
COMMON = 1 << 16
BATCH, RATE = 2048, 0.4
CHUNK, PART = 4 << 20, 16 << 20
FEATURES = 4

_FREQUENT = CLASSES * WIDTH - BUCKETS
_END, _START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk's documents, each with its end, and where each document's begin."""
    words = Chunk(_LOWER[chunk.data], chunk.offsets, chunk.first).words()
    bounds = words.bounds + np.arange(chunk.n + 1)
    out = np.empty(bounds[-1], np.uint64)
    out[bounds[1:] - 1] = _END
    out[np.arange(len(words.starts)) + words.docs()] = words.hashes()
    return out, bounds


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = row_names()
    for batch in batches:
        for chunk in chunks(batch.column("text"), CHUNK):
            own = batch.slice(chunk.first, chunk.n)
            out = own.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            h, bounds = token_hashes(chunk)
            distinct, back = np.unique(h, return_inverse=True)
            order = np.argsort(-np.bincount(back), kind="stable")  # frequent ones get small numbers, which compress
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[back]
            counts = np.bincount(tokens[np.repeat(~out, np.diff(bounds))], minlength=len(order))
            row = [next(names), own.column("doc_id").to_pylist(), out.tolist(), bounds.astype("<i8").tobytes(), distinct[order].tobytes(), counts.astype("<u4").tobytes(), tokens.astype("<u4" if len(order) > 65536 else "<u2").tobytes()]
            kinds = [pa.int64(), pa.list_(own.schema.field("doc_id").type), pa.list_(pa.bool_()), *(pa.binary(),) * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["chunk", "ids", "out", "bounds", "vocabulary", "counts", "tokens"])


class Tokens:
    """A chunk row: its vocabulary's hashes, and its documents' tokens as numbers of those."""

    def __init__(self, r: dict, rows: int = ROWS):
        self.last = np.uint64(rows - 1)
        self.vocabulary, self.bounds = np.frombuffer(r["vocabulary"], np.uint64), np.frombuffer(r["bounds"], "<i8")
        self.tokens = np.frombuffer(r["tokens"], "<u4" if len(self.vocabulary) > 65536 else "<u2").astype(np.int64)
        self.since = np.arange(len(self.tokens)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        self.hashes = np.append(self.vocabulary, _START)  # the last stands for what is before a document
        self.rows = [(mix(self.hashes ^ _SALTS[k]) & self.last).astype(np.int64) for k in (0, 1, 3)]

    def features(self, at: np.ndarray) -> np.ndarray:
        """Rows of the weight tables for the tokens at those places: the token before, the one before that, both, and the one before those."""
        back = [np.where(self.since[at] >= k, self.tokens[np.maximum(at - k, 0)], len(self.vocabulary)) for k in (1, 2, 3)]
        pair = joined(self.hashes[back[1]], self.hashes[back[0]]) & self.last
        return np.column_stack([self.rows[0][back[0]], self.rows[1][back[1]], pair.astype(np.int64), self.rows[2][back[2]]])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The training tokens of each chunk: hash and number."""
    for batch in batches:
        for r in batch.to_pylist():
            counts = np.frombuffer(r["counts"], "<u4")
            seen = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["vocabulary"], np.int64)[seen]), pa.array(counts[seen].astype(np.int64))], names=["hash", "n"])


class Common:
    """The counts of the most frequent tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def find(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of a vocabulary's tokens, and which of them are not here."""
        counts, other = np.zeros(len(vocabulary), np.int64), np.ones(len(vocabulary), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, vocabulary), len(self.hashes) - 1)
            other = self.hashes[at] != vocabulary
            counts[~other] = self.counts[at[~other]]
        return counts, other


def _dealt(vocabulary: np.ndarray, other: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the other tokens in order of the parts they are dealt to, and those parts."""
    at = np.flatnonzero(other)
    part = vocabulary[at].view(np.int64) % parts
    order = np.argsort(part, kind="stable")
    return at[order], part[order]


def _ask(batches: Iterator[pa.RecordBatch], common: Common, parts: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk and part: the hashes whose counts the chunk needs."""
    for batch in batches:
        for r in batch.to_pylist():
            vocabulary = np.frombuffer(r["vocabulary"], np.uint64)
            at, part = _dealt(vocabulary, common.find(vocabulary)[1], parts)
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            own = [vocabulary[at[x:y]].tobytes() for x, y in zip(cut, [*cut[1:], len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array([r["chunk"]] * len(cut), pa.int64()), pa.array(own, pa.binary())], names=["part", "chunk", "hashes"])


def _answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """The counts that the chunks asked a part for, 0 for tokens that no training document has."""
    hashes = [np.frombuffer(x, np.int64) for x in asked.column("hashes").to_pylist()]
    there, n = (counted.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(there)
    there, n = np.append(there[order], 0), np.append(n[order], 0)
    found = []
    for h in hashes:
        at = np.searchsorted(there[:-1], h)
        found.append(np.where((there[at] == h) & (at < len(there) - 1), n[at], 0).astype("<i8").tobytes())
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "counts": pa.array(found, pa.binary())})


@dataclass
class Model:
    """frequent: hashes of the outcomes that are words, sorted, and their numbers; rare: training tokens and words of each bucket, one more for words never seen; weights: of classes and of outcomes within a class, by row, then their biases."""

    n_tokens: int
    n_words: int
    frequent: np.ndarray
    number: np.ndarray
    rare: np.ndarray
    weights: list[np.ndarray]
    classes_bias: np.ndarray
    outcome_bias: np.ndarray

    def outcomes(self, vocabulary: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.frequent, vocabulary), max(len(self.frequent) - 1, 0))
        out = _FREQUENT + (vocabulary % np.uint64(BUCKETS)).astype(np.int64)
        if len(self.frequent):
            known = self.frequent[at] == vocabulary
            out[known] = self.number[at[known]]
        return out

    def logits(self, which: int, rows: np.ndarray, classes: np.ndarray | None) -> np.ndarray:
        z = self.weights[which].take(rows[:, 0], 0, mode="clip")
        for k in range(1, FEATURES):
            z += self.weights[which].take(rows[:, k], 0, mode="clip")
        z += self.classes_bias if classes is None else self.outcome_bias[classes]
        return np.minimum(z, 60, out=z)  # beyond that the exponential would not fit

    def log_softmax(self, which: int, rows: np.ndarray, classes: np.ndarray | None) -> np.ndarray:
        return np.log(self.softmax(which, rows, classes))

    def softmax(self, which: int, rows: np.ndarray, classes: np.ndarray | None) -> np.ndarray:
        z = self.logits(which, rows, classes)
        np.exp(z, out=z)
        z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
        return z

    def log_share(self, which: int, rows: np.ndarray, classes: np.ndarray | None, target: np.ndarray) -> np.ndarray:
        """The log probability of one target in each row."""
        z = self.logits(which, rows, classes)
        own = z[np.arange(len(z)), target]
        return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))

    def inner_rows(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Rows of the second table: a feature and the class together."""
        return (mix(rows.astype(np.uint64) * _SALTS[0] + classes[:, None].astype(np.uint64) * _SALTS[1]) & np.uint64(len(self.weights[1]) - 1)).astype(np.int64)

    def score(self, tokens: Tokens, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By token: log10 of its probability by the unigram base, and by the model."""
        base = np.log10((counts + 1) / (self.n_tokens + self.n_words + 1))[tokens.tokens]
        outcome = self.outcomes(tokens.vocabulary)
        inside = np.where(outcome >= _FREQUENT, np.log((counts + 1) / self.rare[np.maximum(outcome - _FREQUENT, 0)]), 0.0)
        out = np.empty(len(tokens.tokens))
        for a in range(0, len(out), 1 << 13):  # so that a slice's logits stay in the cache
            at = np.arange(a, min(a + (1 << 13), len(out)))
            word = tokens.tokens[at]
            y, rows = outcome[word], tokens.features(at)
            c = y // WIDTH
            out[at] = self.log_share(0, rows, None, c) + self.log_share(1, self.inner_rows(rows, c), c, y % WIDTH) + inside[word]
        return base, out / np.log(10)

    def learn(self, tokens: Tokens, at: np.ndarray, sums: list[np.ndarray], touched: list[np.ndarray]) -> None:
        """One AdaGrad step for each batch of the places at; sums: squared gradients by row, touched: examples by row."""
        outcome = self.outcomes(tokens.vocabulary)
        for a in range(0, len(at), BATCH):
            part = at[a : a + BATCH]
            y, rows = outcome[tokens.tokens[part]], tokens.features(part)
            c, nth = y // WIDTH, np.arange(len(part))
            for which, where, target, classes in ((0, rows, c, None), (1, self.inner_rows(rows, c), y % WIDTH, c)):
                error = self.softmax(which, where, classes)
                error[nth, target] -= 1
                row = where.T.ravel()
                order = np.argsort(row.astype(np.uint16), kind="stable")
                row = row[order]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                # two columns at a time, as complex numbers: half as many additions
                g, row = np.add.reduceat(error.take(order % len(part), 0, mode="clip").view(np.complex64), first).view(np.float32), row[first]
                squares = sums[which][row] + np.einsum("ij,ij->i", g, g) / WIDTH
                sums[which][row] = squares
                touched[which][row] += np.diff(np.append(first, len(order)))
                g *= (RATE / np.sqrt(1 + squares))[:, None]
                self.weights[which][row] -= g


def places(chunk: int, turn: int, rounds: int, n: int) -> np.ndarray:
    """Which of a chunk's n tokens a round learns; all rounds together learn each once."""
    return np.arange((chunk + turn) % rounds, n, rounds)


def _train(batches: Iterator[pa.RecordBatch], model: Model, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Learn on all rows of the task; then the weights times their examples, and the examples, in blocks of rows."""
    rows = len(model.weights[0])
    model.weights = [w.copy() for w in model.weights]
    sums, touched = ([np.zeros(rows, np.float32) for _ in range(2)] for _ in range(2))
    for batch in batches:
        for r in batch.to_pylist():
            tokens = Tokens(r, rows)
            at = places(r["chunk"], turn, rounds, len(tokens.tokens))
            learns = ~np.repeat(np.array(r["out"], bool), np.diff(tokens.bounds))
            model.learn(tokens, at[learns[at]], sums, touched)
    task, blocks = TaskContext.get(), rows // BLOCK
    own = task.partitionId() if task else 0
    out = [(own, which * blocks + k, (model.weights[which][k * BLOCK :][:BLOCK] * touched[which][k * BLOCK :][:BLOCK, None]).astype("<f4").tobytes(), touched[which][k * BLOCK :][:BLOCK].astype("<f4").tobytes()) for which in range(2) for k in range(blocks)]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["task", "block", "weights", "touched"])


def _added(group: pa.Table) -> pa.Table:
    """Sums of a block over some tasks."""
    weights, touched = (np.sum([np.frombuffer(x, "<f4") for x in group.column(c).to_pylist()], axis=0, dtype=np.float64).astype("<f4").tobytes() for c in ("weights", "touched"))
    return pa.table({"block": group.column("block").slice(0, 1), "weights": pa.array([weights], pa.binary()), "touched": pa.array([touched], pa.binary())})


def table_rows(n_tokens: int) -> int:
    """Rows of the weight tables for so many training tokens."""
    return min(max(1 << round(math.log2(max(n_tokens, 1)) / 2), LEAST_ROWS), MOST_ROWS)


def _started(counts: DataFrame) -> tuple[Model, Common]:
    """The model that knows only how frequent outcomes are, and the most frequent tokens; all of fixed size."""
    sums = {r["bucket"]: r for r in counts.groupBy(F.col("hash").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    tokens, words = (np.array([sums[k][c] if k in sums else 0 for k in range(BUCKETS)], np.int64) for c in ("n", "words"))
    top = counts.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    common_h, common_n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    h, n = common_h[:_FREQUENT], common_n[:_FREQUENT]
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    n_tokens, n_words = int(tokens.sum()), int(words.sum())
    rare_tokens, rare_words = tokens - np.bincount(bucket, n, BUCKETS).astype(np.int64), words - np.bincount(bucket, minlength=BUCKETS)
    mass = np.ones(CLASSES * WIDTH)
    mass[: len(n)] += n
    mass[_FREQUENT:] += rare_tokens + rare_words
    mass = mass.reshape(CLASSES, WIDTH)
    order = np.argsort(h)
    zero = lambda: np.zeros((table_rows(n_tokens), WIDTH), np.float32)
    model = Model(n_tokens, n_words, h[order], order, rare_tokens + rare_words + 1, [zero(), zero()], np.log(mass.sum(1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32))
    return model, Common(common_h, common_n)


def _trained(table: DataFrame, n_chunks: int, model: Model, rounds: int) -> Model:
    context, blocks, kinds = table.sparkSession.sparkContext, len(model.weights[0]) // BLOCK, "block int, weights binary, touched binary"
    own = table.select("chunk", "out", "bounds", "vocabulary", "tokens")
    groups = math.isqrt(n_chunks) + 1  # so that what one task adds up grows with the root of the tasks at most
    for turn in range(rounds):
        sent = context.broadcast(model)  # of bounded size
        learnt = own.mapInArrow(lambda b, sent=sent, turn=turn: _train(b, sent.value, turn, rounds), f"task int, {kinds}")
        some = learnt.groupBy("block", F.col("task") % groups).applyInArrow(_added, kinds)
        for r in some.groupBy("block").applyInArrow(_added, kinds).collect():
            which, k = divmod(r["block"], blocks)
            n = np.frombuffer(r["touched"], "<f4")
            rows = model.weights[which][k * BLOCK : (k + 1) * BLOCK]
            rows[n > 0] = (np.frombuffer(r["weights"], "<f4").reshape(BLOCK, -1) / np.maximum(n, 1)[:, None])[n > 0]
        sent.unpersist()
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Model, common: Common, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            tokens = Tokens(r, len(model.weights[0]))
            counts, other = common.find(tokens.vocabulary)
            at, _ = _dealt(tokens.vocabulary, other, parts)
            counts[at] = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["counts"], "<i8") for x in sorted(r["found"] or (), key=lambda x: x["part"]))])
            base, score = model.score(tokens, counts)
            sums = [np.add.reduceat(x, tokens.bounds[:-1]) for x in (base, score, (counts > 0)[tokens.tokens].astype(np.int64))]
            n = len(r["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], batch.schema.field("ids").type.value_type), pa.array(r["out"], pa.bool_()), pa.array(np.diff(tokens.bounds), pa.int64()), pa.array(sums[2], pa.int64()), pa.array([model.n_tokens] * n, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def language_model_scores(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text by add-one unigrams and by the model).

    documents: doc_id and text; other columns are ignored. A null or empty text is its end alone; repeated rows count and are scored each for itself; a row without doc_id trains; an empty table gives an empty result. Without training tokens both scores spread all mass over words never seen.
    """
    bounded_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    table = written(docs.mapInArrow(_tokenize, f"chunk long, ids array<{kind}>, out array<boolean>, bounds binary, vocabulary binary, counts binary, tokens binary"), "zstd")
    size, n_chunks = table.agg(F.sum(F.octet_length("vocabulary")), F.count("*")).first()
    parts = max(12, -(-(size or 0) // PART))
    counts = written(table.select("vocabulary", "counts").mapInArrow(_entries, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    model, common = _started(counts)
    context = documents.sparkSession.sparkContext
    model, common = context.broadcast(_trained(table, n_chunks, model, rounds)), context.broadcast(common)  # of bounded size
    asked = table.select("chunk", "vocabulary").mapInArrow(lambda b: _ask(b, common.value, parts), "part long, chunk long, hashes binary")
    by_part = counts.select(F.pmod("hash", F.lit(parts)).alias("part"), "hash", "n").groupBy("part")
    found = asked.groupBy("part").cogroup(by_part).applyInArrow(_answer, "chunk long, part long, counts binary")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts")).alias("found"))  # of one chunk's bounded size
    both = table.drop("counts").join(found, "chunk", "left")
    return both.mapInArrow(lambda b: _scores(b, model.value, common.value, parts), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
