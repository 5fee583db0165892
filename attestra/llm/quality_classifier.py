"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by what its words look like (no word lists, no identifiers, no metadata), gated attention learnt from document labels weighs the passages, and the weighted representation gives the score. The model is fitted on a bounded sample of labelled documents; every passage of every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestra.llm.shared_tables import bounded_batches, packed, packed_column
from attestra.llm.text_arrays import Chunk, chunks, members

PASSAGE = 64
#: Labelled documents in the fitted sample at most, with all their passages.
SAMPLE_DOCUMENTS = 6000
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = members(bytes(range(0x41, 0x5B))), members(bytes(range(0x61, 0x7B))), members(b"0123456789")
_HIGH = members(bytes(range(0x80, 0x100)))
_LETTER = _UPPER | _LOWER | _HIGH
_STOP = members(b".,;:?!")
_FIRST = np.select([_LOWER | _HIGH, _UPPER, _DIGIT], [0, 1, 2], 3).astype(np.int64)
_LAST = np.select([_LETTER, _STOP, _DIGIT], [0, 1, 2], 3).astype(np.int64)
SHAPES = 32
FEATURES = 12 + SHAPES


def encoded(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The passages' features, and how many passages each document has (an empty one has one, of zeros)."""
    words, data = chunk.words(), chunk.data
    h, docs, n = words.hashes(), words.docs(), len(words.starts)
    per_doc = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.cumsum(per_doc) - per_doc
    within = np.arange(n) - np.repeat(words.bounds[:-1], words.counts)
    passage, total = first[docs] + within // PASSAGE, int(per_doc.sum())
    length, last = words.ends - words.starts, words.ends - 1
    n_upper, n_letters, n_digits = (x[words.ends] - x[words.starts] for x in (np.concatenate([[0], np.cumsum(x[data], dtype=np.int32)]) for x in (_UPPER, _LETTER, _DIGIT)))
    order = np.lexsort((h, docs))
    fresh = np.ones(n, bool)
    fresh[order[1:]] = (h[order][1:] != h[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    at, windows = words.windows(h, 3)
    order = np.lexsort((windows, docs[at]))
    again = np.zeros(n, bool)
    again[at[order[1:]][(windows[order][1:] == windows[order][:-1]) & (docs[at][order][1:] == docs[at][order][:-1])]] = True
    tail = data[last] if n else np.zeros(0, np.uint8)
    head = data[words.starts] if n else np.zeros(0, np.uint8)
    columns = [
        (n_upper >= 2) & (n_upper == n_letters),
        (length <= 4) & (n_letters == length),
        _STOP[tail] & (length > 1),
        _LAST[tail] == 3,
        tail == ord("!"),
        n_digits > 0,
        _HIGH[head] | _HIGH[tail],
        np.minimum(length, 40) / 10,
        ~fresh,
        again,
    ]
    counts = np.bincount(passage, minlength=total).astype(float)
    size = np.maximum(counts, 1)[:, None]
    shape = _FIRST[head] * 8 + _LAST[tail] * 2 + (length > 3)
    shapes = np.bincount(passage * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES)
    out = np.column_stack([*(np.bincount(passage, c, minlength=total) for c in columns)]) / size
    whole = np.repeat(np.log1p(words.counts) / 5, per_doc)
    return np.column_stack([out, counts / PASSAGE, whole, shapes / size]).astype(np.float32), per_doc


@dataclass
class Model:
    """Parameters of the encoder, the gate and the score; shift and scale bring features to mean 0 and spread 1."""

    shift: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def run(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        x = np.clip((x - self.shift) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def slopes(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the documents' mean log loss; doc: the document of each passage."""
        p, r = self.parts, self.run(x, starts, sizes)
        ds = (r["s"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[doc] * r["h"]).sum(1)
        de = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, starts), sizes))
        dt, dg = de[:, None] * p["w"] * r["g"] * (1 - r["t"] ** 2), de[:, None] * p["w"] * r["t"] * r["g"] * (1 - r["g"])
        dh = (r["a"][:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - r["h"] ** 2)
        return {"W": r["x"].T @ dh, "b": dh.sum(0), "V": r["h"].T @ dt, "U": r["h"].T @ dg, "w": (r["t"] * r["g"]).T @ de, "c": r["z"].T @ ds, "d": ds.sum()}


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 250, width: int = 16, gates: int = 8, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the mean log loss of the documents, all at a time; without labels of both kinds, a constant."""
    rnd = np.random.default_rng(seed)
    shift, scale = (x.mean(0), np.maximum(x.std(0), 0.02)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    p = {"W": rnd.normal(0, FEATURES**-0.5, (FEATURES, width)), "b": np.zeros(width), "V": rnd.normal(0, width**-0.5, (width, gates)), "U": rnd.normal(0, width**-0.5, (width, gates)), "w": rnd.normal(0, gates**-0.5, gates), "c": np.zeros(width), "d": np.zeros(())}
    share = (y.sum() + 0.5) / (len(y) + 1)
    p["d"] = np.log(share / (1 - share))
    model = Model(shift.astype(np.float32), scale.astype(np.float32), p)
    if len(set(y.tolist())) < 2:
        return model
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        grad = model.slopes(x, starts, sizes, doc, y)
        for k in p:
            g = grad[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.parts = {k: np.asarray(q, np.float32) for k, q in p.items()}
    return model


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            x, per_doc = encoded(chunk)
            bags, at = [], 0
            for n in per_doc.tolist():
                bags.append(x[at : at + n].tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column("y").slice(chunk.first, chunk.n)], names=["bag", "y"])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Fit on at most `sample` labelled documents that are not held out: those whose ids hash lowest. Documents whose labels contradict each other are not learnt from. Of an id with several rows one text is learnt from, so that no more than `sample` bags come to the driver."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most"))
    marked = marked.where("y = most").select("doc_id", F.col("y").cast("double").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.struct(F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string").alias("text"))
    bags = documents.select("doc_id", text.alias("text")).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text")["text"].alias("text"), F.first("y").alias("y")).select("text", "y")
    got = bags.mapInArrow(_encode_batches, "bag binary, y double").collect()
    got = sorted(got, key=lambda r: (bytes(r["bag"]), r["y"]))  # the order of the rows must not tell in the sums
    x = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in got]
    return fit(np.concatenate([np.zeros((0, FEATURES), np.float32), *x]), np.array([len(b) for b in x], int), np.array([r["y"] for r in got]))


_NEW = ("held_out", "score", "predicted")


def with_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """documents with three more columns: held_out, score (0 to 1, higher: good likelier) and predicted (score >= threshold).

    documents: doc_id and text, labels: doc_id and quality (0 or 1; null: unknown; several that disagree: not learnt from). Every passage of a text of any length counts, in learning and in scoring. A null or empty text is scored as one passage without words. Repeated rows get equal scores; a null doc_id counts as held out and is carried through. Columns of documents that clash with the new ones, in any case of letters, are replaced; text comes back as a string. Without labels of both kinds every score is the share of good ones, 0.5 if there are none.
    """
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, sample))
    frame = packed(documents)
    schema = StructType([*frame.schema, StructField("score__", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                x, sizes = encoded(chunk)
                s = model.run(x, np.cumsum(sizes) - sizes, sizes)["s"].astype(float)
                yield pa.RecordBatch.from_arrays([*batch.slice(chunk.first, chunk.n).columns, pa.array(s)], names=schema.names)

    kept = [c for c in documents.columns if c.lower() not in _NEW]
    scored = frame.mapInArrow(score, schema)
    return scored.select(*(packed_column(documents.columns, c).alias(c) for c in kept), F.col("score__").alias("score"), held_out().alias("held_out"), (F.col("score__") >= threshold).cast("int").alias("predicted"))
