"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones are all that is learnt from; that a document is not marked toxic says nothing. The risk of a classifier on unlabelled text is corrected by the class prior, and where the correction turns negative, which only overfitting can do, that part of the step is taken back (the non-negative estimator). The classifier is linear over which words, and beginnings of words, a text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestra.llm.shared_tables import bounded_batches, packed, packed_column, written
from attestra.llm.text_arrays import Chunk, chunks, mix

THRESHOLD = 0.3
#: Documents that are learnt from at most: confirmed toxic ones, and unlabelled ones.
SAMPLE_TOXIC, SAMPLE_UNLABELLED = 4000, 8000
#: Buckets of hashed features, and how many of them a classifier may use.
BUCKETS, SELECTED = 1 << 20, 4096
#: Lengths in bytes of the beginnings of words that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Twice the log likelihood ratio that a feature's excess among toxic documents must reach: by chance about one bucket of all would.
EVIDENCE = 24.0

_ENDS_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def features(chunk: Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets of the features in a chunk, each pair once, by document; wanted: flags of the buckets that count."""
    lowered = Chunk(_LOWER[chunk.data], chunk.offsets, chunk.first)
    words = lowered.words(_ENDS_WORD)
    docs, length = words.docs().astype(np.int64), words.ends - words.starts
    first = lowered.loads()[words.starts]
    pairs = []

    def add(owners: np.ndarray, hashes: np.ndarray) -> None:
        buckets = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if wanted is not None:
            some = wanted[buckets]
            owners, buckets = owners[some], buckets[some]
        pairs.append(owners * BUCKETS + buckets)

    add(docs, words.hashes())
    for k in BEGINNINGS:
        long = length >= k
        begin = first[long]
        add(docs[long], mix((begin if k == 8 else begin & np.uint64((1 << 8 * k) - 1)) + np.uint64(k)))
    found = np.unique(np.concatenate(pairs))
    return found // BUCKETS, found % BUCKETS


@dataclass
class Model:
    """weights of the buckets that are used (sorted), and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def wanted(self) -> np.ndarray:
        flags = np.zeros(BUCKETS, bool)
        flags[self.buckets] = True
        return flags

    def scores(self, docs: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Of n documents; buckets: those of the model that each has."""
        z = np.bincount(docs, self.weights[np.searchsorted(self.buckets, buckets)], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _risks(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The prior's share of the toxic documents' risk, the corrected risk of the others, and the gradients of both by z. The loss is logistic."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    as_toxic, as_clean = np.logaddexp(0, -z), np.logaddexp(0, z)
    toxic = prior * as_toxic[positive].sum() / n_p
    clean = as_clean[~positive].sum() / n_u - prior * as_clean[positive].sum() / n_p
    to_toxic = np.where(positive, prior * (p - 1) / n_p, 0.0)
    to_clean = np.where(positive, -prior * p / n_p, p / n_u)
    return float(toxic), float(clean), to_toxic, to_clean


def fit(docs: np.ndarray, columns: np.ndarray, n_columns: int, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R(toxic as toxic) + max(0, R(unlabelled as clean) - prior * R(toxic as clean)) + decay * |w|^2 / 2, by Adam over all documents at a time. docs and columns: the places of the ones in the matrix of documents by features."""
    n = len(positive)
    w, bias = np.zeros(n_columns), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    for step in range(1, steps + 1):
        z = np.bincount(docs, w[columns], minlength=n) + bias
        _, clean, to_toxic, to_clean = _risks(z, positive, prior)
        by_z = to_toxic + to_clean if clean >= 0 else -to_clean
        g = np.append(np.bincount(columns, by_z[docs], minlength=n_columns) + decay * w, by_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def _sample(documents: DataFrame, labels: DataFrame, toxic: int, unlabelled: int) -> tuple[DataFrame, float | None]:
    """doc_id, toxic and unlabelled of the documents that are learnt from, and the class prior that the labels show. Ids whose hash is lowest are taken. The unlabelled ones are a sample of all documents, confirmed ones included, as the estimator asks for."""
    learnt = ~held_out() & F.col("doc_id").isNotNull()
    marked = labels.where(learnt & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("most")).where("y = most")
    n, n_toxic = marked.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    there = documents.where(learnt).select("doc_id").distinct()
    lowest = lambda df, k: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    positive = lowest(marked.where("y = 1").select("doc_id"), toxic).withColumn("toxic", F.lit(True))
    chosen = lowest(there, unlabelled).withColumn("unlabelled", F.lit(True)).join(positive, "doc_id", "full")
    if n_toxic and n_toxic == n:  # labels that mark nothing but toxic documents tell no share among them
        n = there.count()
    prior = min(max(n_toxic / n, 1e-4), 0.999) if n_toxic else None
    return chosen.select("doc_id", F.coalesce("toxic", F.lit(False)).alias("toxic"), F.coalesce("unlabelled", F.lit(False)).alias("unlabelled")), prior


def _encoded(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                docs, buckets = features(chunk)
                bounds, own = np.searchsorted(docs, np.arange(chunk.n + 1)), batch.slice(chunk.first, chunk.n)
                packed_buckets = [buckets[a:b].astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("toxic"), own.column("unlabelled"), pa.array(packed_buckets, pa.binary())], names=["toxic", "unlabelled", "buckets"])

    return sample.mapInArrow(run, "toxic boolean, unlabelled boolean, buckets binary")


def _selected(encoded: DataFrame, most: int, evidence: float) -> np.ndarray:
    """The buckets, sorted, that are in more of the toxic documents than their share of all would give, by likelihood ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for toxic, unlabelled, buckets in zip(*(batch.column(c).to_pylist() for c in ("toxic", "unlabelled", "buckets")), strict=True):
                at = np.frombuffer(buckets, np.uint32)
                n[0, at] += toxic
                n[1, at] += unlabelled
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "n_toxic", "n_all"])

    n_toxic, n_all = encoded.agg(F.sum(F.col("toxic").cast("int")), F.sum(F.col("unlabelled").cast("int"))).first()
    counts = encoded.mapInArrow(count, "bucket long, n_toxic long, n_all long").groupBy("bucket").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_all").alias("n_all"))
    expected = F.greatest("n_all", F.col("n_toxic")) * F.lit(n_toxic / max(n_all or 0, n_toxic))
    ratio = 2 * (F.col("n_toxic") * F.log(F.col("n_toxic") / expected) - (F.col("n_toxic") - expected))
    told = counts.where(F.col("n_toxic") > expected).select("bucket", ratio.alias("ratio")).where(F.col("ratio") >= evidence)
    return np.sort(np.array([r[0] for r in told.orderBy(F.desc("ratio"), "bucket").limit(most).collect()], np.int64))


def trained(documents: DataFrame, labels: DataFrame, prior: float | None = None, toxic: int = SAMPLE_TOXIC, unlabelled: int = SAMPLE_UNLABELLED, selected: int = SELECTED, evidence: float = EVIDENCE) -> Model | None:
    """Fit on confirmed toxic and unlabelled documents that are not held out, at most so many of each; None if no toxic one is known. Of an id with several texts one is learnt from. prior: the share of toxic documents; by default that among labelled ones."""
    sample, shown = _sample(documents, labels, toxic, unlabelled)
    if shown is None:
        return None
    text = F.col("text").cast("string")
    texts = documents.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic", "unlabelled"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    encoded = written(_encoded(texts.select("row.*")))
    if encoded.where("toxic").isEmpty():
        return None
    buckets = _selected(encoded, selected, evidence)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(np.isin(buckets, np.frombuffer(b, np.uint32))).astype(np.uint16).tobytes() for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("unlabelled"), pa.array(kept, pa.binary())], names=["toxic", "unlabelled", "columns"])

    rows = encoded.mapInArrow(narrowed, "toxic boolean, unlabelled boolean, columns binary").collect()
    rows.sort(key=lambda r: (r["toxic"], r["unlabelled"], bytes(r["columns"])))  # the order of the rows must not tell in the sums
    used = [(kind, np.frombuffer(r["columns"], np.uint16).astype(np.int64)) for kind in (False, True) for r in rows if r["toxic" if kind else "unlabelled"]]
    docs = np.repeat(np.arange(len(used)), [len(x) for _, x in used])
    columns = np.concatenate([np.zeros(0, np.int64), *(x for _, x in used)])
    weights, bias = fit(docs, columns, len(buckets), np.array([kind for kind, _ in used], bool), shown if prior is None else prior)
    return Model(buckets, weights, bias)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


_NEW = ("held_out", "score", "predicted")


def with_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """documents with three more columns: held_out, score (0 to 1, higher: toxic likelier) and predicted (score >= threshold).

    documents: doc_id and text, labels: doc_id and toxic (1: confirmed; 0 and null: nothing is known, but that 0 counts towards the share of toxic documents; an id marked both ways is not learnt from). training: parameters of trained(). Every text is scored whole, however long; a null text counts as empty, and both have the score of a text without any feature. Rows of equal text get equal scores. A null doc_id is not learnt from and its row is carried through. Where no toxic document is known, every score is 0. Columns of documents that clash with the new ones, in any case of letters, are replaced.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(trained(documents, labels, **training))
    frame = packed(documents)
    schema = StructType([*frame.schema, StructField("score__", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        wanted = model.wanted() if model else None
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = model.scores(*features(chunk, wanted), chunk.n) if model else np.zeros(chunk.n)
                yield pa.RecordBatch.from_arrays([*batch.slice(chunk.first, chunk.n).columns, pa.array(found)], names=schema.names)

    scored = frame.mapInArrow(score, schema)
    kept = [c for c in documents.columns if c.lower() not in _NEW]
    return scored.select(*(packed_column(documents.columns, c).alias(c) for c in kept), held_out().alias("held_out"), F.col("score__").alias("score"), (F.col("score__") >= threshold).cast("int").alias("predicted"))
