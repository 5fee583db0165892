"""Near-duplicate documents: ProbMinHash signatures of five-word shingles, banding, and exact verification.

Each shingle of a document arrives at random registers at the times of a Poisson process whose rate is its weight, 1 for all: a weight by occurrences would differ between copies, and links are of distinct shingles. A register keeps the shingle that comes first. An element is dropped as soon as its next arrival is later than every register's first one. Two registers agree with the Jaccard similarity of the documents. Registers in bands make buckets; within a bucket documents are compared with one member, its hub, not all with all, and what that leaves apart is compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.components import components
from attestra.llm.shared_tables import bounded_batches, packed, unpacked, written
from attestra.llm.text_arrays import Chunk, chunks, joined, mix

SHINGLE, SIMILARITY = 5, 0.8
#: Two documents of similarity 0.8 share a bucket with probability 1 - (1 - 0.8**4)**20, over 0.9999.
BANDS, ROWS = 20, 4

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """The distinct shingles of a chunk's documents, sorted within each: hash, document, and where each document's begin."""

    def __init__(self, chunk: Chunk, size: int = SHINGLE):
        words = chunk.words()
        h = words.hashes()
        at, window = words.windows(h, size)
        docs = words.docs()[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))  # all words together
        whole = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short.tolist()):
            x = np.uint64(0)
            for w in h[words.bounds[i] : words.bounds[i + 1]]:
                x = joined(np.array([x]), np.array([w]))[0]
            whole[k] = x
        window, docs = np.concatenate([window, whole]), np.concatenate([docs, short])
        order = np.lexsort((window, docs))
        window, docs = window[order], docs[order]
        fresh = np.ones(len(window), bool)
        fresh[1:] = (window[1:] != window[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(fresh)
        self.hash, self.doc, self.n = window[at], docs[at], chunk.n
        self.bounds = np.searchsorted(self.doc, np.arange(chunk.n + 1))
        self.sizes = np.diff(self.bounds)

    def fingerprints(self) -> list[bytes | None]:
        """16 bytes that tell each document's set of shingles; None for an empty set."""
        parts = []
        for salt in (_GOLDEN, ~_GOLDEN):
            total = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(mix(self.hash ^ salt), out=total[1:])
            parts.append(mix((total[self.bounds[1:]] - total[self.bounds[:-1]]) ^ self.sizes.astype(np.uint64)))
        both = np.column_stack(parts).astype(">u8")
        return [both[i].tobytes() if self.sizes[i] else None for i in range(self.n)]


def prob_min_hash(sets: Shingles, k: int) -> np.ndarray:
    """k registers by document: the hash of the shingle that arrived first."""
    first = np.full(sets.n * k, np.inf)
    kept = np.zeros(sets.n * k, np.uint64)
    state, doc, element = mix(sets.hash * _GOLDEN), sets.doc.astype(np.int64), sets.hash
    time, latest = np.zeros(len(element)), np.full(sets.n, np.inf)
    while len(element):
        state = mix(state + _GOLDEN)
        time = time - np.log1p((state >> np.uint64(11)).astype(float) * -(2.0**-53))
        on = np.flatnonzero(time < latest[doc])  # the others can no longer be first anywhere
        state, doc, element, time = state[on], doc[on], element[on], time[on]
        register = doc * k + (mix(state ^ _GOLDEN) % np.uint64(k)).astype(np.int64)
        before = first[register]
        np.minimum.at(first, register, time)
        won = np.flatnonzero((time == first[register]) & (time < before))
        kept[register[won]] = element[won]
        open_ = np.unique(doc[won])
        latest[open_] = first.reshape(sets.n, k)[open_].max(1)
    return kept.reshape(sets.n, k)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket for each band of a signature's registers."""
    n, k = signature.shape
    out = np.zeros((n, k // rows), np.uint64)
    for b in range(k // rows):
        x = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            x = joined(x, signature[:, b * rows + r])
        out[:, b] = x
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text"), 2 << 20):
            sets = Shingles(chunk)
            keys = bands(prob_min_hash(sets, BANDS * ROWS)).view(np.int64)
            own = batch.slice(chunk.first, chunk.n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (chunk.n + 1), BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), pa.array(sets.fingerprints(), pa.binary()), pa.array(sets.sizes, pa.int64()), lists], names=["doc_id", "text_hash", "node", "n_shingles", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text"), 2 << 20):
            sets = Shingles(chunk)
            own = [sets.hash[sets.bounds[i] : sets.bounds[i + 1]].tobytes() for i in range(chunk.n)]
            found = batch.slice(chunk.first, chunk.n)
            same = [x == y for x, y in zip(sets.fingerprints(), found.column("node").to_pylist(), strict=True)]  # not so for another text of that hash
            yield pa.RecordBatch.from_arrays([found.column("node"), found.column("bands"), pa.array(own, pa.binary())], names=["node", "bands", "shingles"]).filter(pa.array(same, pa.bool_()))


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets, each sorted and distinct, is at least that."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    short, long_ = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(long_, short), len(long_) - 1)
    both = int((long_[at] == short).sum())
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("set_a", "set_b"))
        keep = [similar(x, y) for x, y in zip(a, b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: Of a bucket's documents that are apart from its largest component, and of all its documents, so many meet in one group of a task.
APART, OTHERS = 128, 512


def _compare(group: pa.Table) -> pa.Table:
    """Links between components, of the documents left apart and the others of one block of a bucket; a pair counts in the first bucket it shares, and components that are linked in the block are not compared again."""
    own = {c: group.column(c).combine_chunks() for c in ("apart", "component", "bands", "shingles")}
    sets = [np.frombuffer(x, np.uint64) for x in own["shingles"].to_pylist()]
    keys = own["bands"].flatten().to_numpy().reshape(len(sets), -1)
    side = own["apart"].to_numpy(zero_copy_only=False)
    apart, others = np.flatnonzero(side), np.flatnonzero(~side)
    band = int(np.flatnonzero(keys[0] == group.column("key")[0].as_py())[0])
    code = own["component"].dictionary_encode()
    label, names = code.indices.to_numpy().copy(), code.dictionary
    sizes = np.array([len(x) for x in sets])
    if not len(apart) or not len(others):
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    distinct, number = np.unique(np.concatenate([sets[k] for k in others]), return_inverse=True)
    first = np.cumsum(sizes[others]) - sizes[others]
    start, found = label.copy(), []
    for u in apart.tolist():
        earlier = (keys[others][:, :band] == keys[u][:band]).any(1)
        fits = (np.minimum(sizes[others], sizes[u]) >= SIMILARITY * np.maximum(sizes[others], sizes[u])) & ~earlier & (label[others] != label[u])
        if not fits.any():
            continue
        at = np.minimum(np.searchsorted(distinct, sets[u]), len(distinct) - 1)
        has = np.zeros(len(distinct), np.int32)
        has[at[distinct[at] == sets[u]]] = 1
        both = np.add.reduceat(has[number], first)
        for v in others[fits & (both >= SIMILARITY * (sizes[others] + sizes[u] - both) - 1e-9)].tolist():
            if label[u] != label[v]:
                found.append((start[u], start[v]))
                label[label == label[v]] = label[u]
    a, b = (pa.array(np.array([x[side] for x in found], np.int32)) for side in (0, 1))
    return pa.table({"a": names.take(a), "b": names.take(b)})


def _apart(buckets: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between components of the documents of a bucket, beside those with its hub: what lies outside the bucket's largest component is compared with all the bucket."""
    # tables that are joined by bucket are written before, so that Spark may split a hot bucket's join
    labelled = buckets.where("size > 2 AND node != hub").join(found, "node", "left")
    labelled = written(labelled.select("key", "node", F.coalesce("component", "node").alias("component")))
    tally = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    homes = tally.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("home")).where("n > home.n")
    homes = written(homes.select("key", F.col("home.component").alias("home"), F.ceil((F.col("n") - F.col("home.n")) / APART).alias("rows_"), F.ceil(F.col("n") / OTHERS).alias("columns_")))
    members = labelled.join(homes, "key").withColumn("apart", F.col("component") != F.col("home")).join(sets, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = members.where("apart").withColumn("row", own("rows_")).withColumn("column", every("columns_"))
    cells = cells.unionByName(members.withColumn("apart", F.lit(False)).withColumn("column", own("columns_")).withColumn("row", every("rows_")))
    return written(cells.select("key", "row", "column", "component", "apart", "shingles", "bands").groupBy("key", "row", "column").applyInArrow(_compare, "a binary, b binary"))


def _classes(documents: DataFrame, signed: DataFrame) -> DataFrame:
    """node (a distinct set of shingles, by its fingerprint) and class: the least doc_id of what links of similarity SIMILARITY or more, within the buckets, connect it with."""
    nodes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("m")).select("node", "m.*")
    nodes = written(nodes)
    entries = nodes.select("node", F.explode("bands").alias("key"))
    # as fingerprints are random, near copies have the same least one in most of their buckets
    hubs = written(entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1"))
    buckets = written(entries.join(hubs, "key"))
    chosen = nodes.join(buckets.select("node"), "node", "left_semi")
    texts = documents.join(chosen, ["doc_id", "text_hash"]).select("node", "bands", "text")
    sets = written(texts.mapInArrow(_sets, "node binary, bands array<long>, shingles binary").dropDuplicates(["node"]))
    stars = buckets.where("node != hub").groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # one hub a band at most
    pairs = stars.join(sets, "node").select(F.col("node").alias("a"), F.col("shingles").alias("set_a"), F.explode("hubs").alias("b"))
    links = written(pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b").mapInArrow(_verify, "a binary, b binary"))
    found = components(links)
    # what a hub leaves apart may belong to others of its bucket
    joined_ = components(_apart(buckets, sets, found))
    every = found.unionByName(joined_.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
    whole = joined_.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    owned = every.join(nodes.select("node", "doc_id"), "node").join(whole, "component", "left")
    owned = written(owned.select("node", "doc_id", F.coalesce("whole", "component").alias("component")))
    least = written(owned.groupBy("component").agg(F.min("doc_id").alias("class")))
    classes = nodes.select("node", "doc_id").join(owned.join(least, "component").select("node", "class"), "node", "left")
    return written(classes.select("node", F.coalesce("class", "doc_id").alias("class")))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles and class_id, the least doc_id of its class.

    A class is what links of Jaccard similarity SIMILARITY or more, over sets of five-word shingles, connect. documents: doc_id and text; other columns are ignored. A text of fewer than five words has one shingle of all of them; one without words, or null, is in a class of its own. Texts of any length are compared whole; the least doc_id settles ties. A null doc_id has the null class and links nothing. Repeated rows share their class; an empty table gives an empty result.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    signed = written(docs.mapInArrow(_sign, f"doc_id {kind}, text_hash long, node binary, n_shingles long, bands array<long>"))
    classes = _classes(docs, signed)
    out = signed.join(classes, "node", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "class_id")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents, of each class the one of least doc_id; of rows equal in doc_id and text one. Rows with a null doc_id stay."""
    found = near_duplicates(documents)
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    docs = packed(documents).withColumn("text_hash", F.xxhash64("text"))
    one = docs.where("doc_id IS NOT NULL").join(kept, (F.col("doc_id") == F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return unpacked(one.unionByName(docs.where("doc_id IS NULL")), documents.columns)
