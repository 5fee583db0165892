"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items, lower-cased, go into one suffix automaton; each document's words stream through it, and wherever the longest match reaches a window (ten words, or a whole shorter item), its words are hit. Runs of document words whose neighbouring pairs no item has cannot hold a window and never reach the automaton.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches, packed, packed_column, unpacked, written
from attestra.llm.text_arrays import Chunk, chunks, covered, joined, members

WINDOW = 10
#: Words of test items in one automaton; more items make more blocks, each a pass over the documents.
BLOCK_WORDS = 400_000

ENDS_WORD = members(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def item_words(text: str | None) -> list[bytes]:
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    words = Chunk(data, np.array([0, len(data)])).words(ENDS_WORD)
    return [data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]


class Automaton:
    """Suffix automaton of several word sequences: by state, the longest string, its suffix link and its transitions."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.items: dict[int, set[int]] = {}  # by state: items that have its strings of WINDOW words
        self.whole: dict[int, list[int]] = {}  # by state: short items that are its string

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        return len(self.length) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # the string is there already
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            last = new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state of the longest suffix that some item has, and its length."""
        state, matched, step, link, length = 0, 0, self.next, self.link, self.length
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            yield state, matched

    def windows(self, state: int, matched: int) -> Iterator[tuple[int, tuple]]:
        """Of the windows that end here: their words, and the items."""
        length, link = self.length, self.link
        if matched >= WINDOW:
            at = state
            while length[link[at]] >= WINDOW:
                at = link[at]
            if at in self.items:
                yield WINDOW, self.items[at]
        while state > 0:
            if state in self.whole and length[state] <= matched:
                yield length[state], self.whole[state]
            state = link[state]


class Items:
    """The test items of a block, ready to be looked for: their word hashes, neighbouring pairs and automaton."""

    def __init__(self, items: list[tuple[object, str | None]]):
        split = [(i, w) for i, w in ((i, item_words(t)) for i, t in items) if w]
        self.ids = [i for i, _ in split]
        vocabulary = sorted({x for _, w in split for x in w})
        hashes = np.zeros(0, np.uint64)
        if vocabulary:
            data = np.frombuffer(b" ".join(vocabulary), np.uint8)
            hashes = Chunk(data, np.array([0, len(data)])).words().hashes()
        self.shortest = min([WINDOW, *(len(w) for _, w in split)])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {x: k for k, x in enumerate(vocabulary)}
        lines = [[number[x] for x in w] for _, w in split]
        pairs = {(x[k], x[k + 1]) for x in lines for k in range(len(x) - 1)}
        left, right = (np.array([hashes[p[k]] for p in pairs], np.uint64) for k in (0, 1))
        self.pairs = np.sort(joined(left, right))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.pairs >> np.uint64(44)] = True
        self.word_sieve = np.zeros(1 << 20, bool)
        self.word_sieve[self.hashes >> np.uint64(44)] = True
        self.automaton = a = Automaton()
        for x in lines:
            a.add(x)
        for k, x in enumerate(lines):
            for state, matched in a.walk(x):
                if len(x) >= WINDOW and matched >= WINDOW:
                    while a.length[a.link[state]] >= WINDOW:
                        state = a.link[state]
                    a.items.setdefault(state, set()).add(k)
            if len(x) < WINDOW:
                a.whole.setdefault(state, []).append(k)

    @staticmethod
    def words_in(table: np.ndarray, sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = sieve[h >> np.uint64(44)]
        some = np.flatnonzero(out)
        if len(some):
            where = np.minimum(np.searchsorted(table, h[some]), len(table) - 1)
            out[some] = table[where] == h[some]
        return out

    def search(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]], np.ndarray]:
        """By word: is it hit; by document: its words, the items found (where there are any), and where its words begin."""
        chunk = Chunk(_LOWER[chunk.data], chunk.offsets, chunk.first)
        words = chunk.words(ENDS_WORD)
        n = len(words.starts)
        found: dict[int, set[int]] = {}
        if not n or not self.ids:
            return np.zeros(n, bool), words.counts, found, words.bounds
        h = words.hashes()
        goes_on = np.zeros(n, bool)  # the pair of this word and the next is in some item
        goes_on[:-1] = self.words_in(self.pairs, self.sieve, joined(h[:-1], h[1:])) if len(self.pairs) else False
        goes_on[words.bounds[1:][words.counts > 0] - 1] = False
        breaks = np.flatnonzero(~goes_on)
        begins = np.concatenate([[0], breaks[:-1] + 1])
        lengths = breaks + 1 - begins
        keep = lengths >= self.shortest
        if self.shortest == 1:
            keep &= self.words_in(self.hashes, self.word_sieve, h[begins]) | (lengths > 1)
        hits: dict[int, list[int]] = {}
        for begin, length in zip(begins[keep].tolist(), lengths[keep].tolist(), strict=True):
            where = np.searchsorted(self.hashes, h[begin : begin + length])
            doc = None
            for k, (state, matched) in enumerate(self.automaton.walk(self.order[np.minimum(where, len(self.order) - 1)].tolist())):
                if matched >= self.shortest:
                    for width, items in self.automaton.windows(state, matched):
                        hits.setdefault(width, []).append(begin + k + 1 - width)
                        if doc is None:
                            doc = int(np.searchsorted(words.bounds, begin, "right")) - 1
                        found.setdefault(doc, set()).update(items)
        hit = np.zeros(n, bool)
        for width, at in hits.items():
            hit |= covered(np.array(at), width, n)
        return hit, words.counts, found, words.bounds


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (sorted as strings), hits (maximal runs of hit words as [first, end) word numbers).

    documents: doc_id and text, benchmark: item_id and text; other columns are ignored. Null and empty texts have no words; texts of any length are searched whole. Items without words are never found; equal items are found together, and items without an id count for hits alone. Repeated documents are searched each for itself; empty tables give no rows, or no hits. The driver reads the items block by block, each of at most block_words words or one item; a block's automaton goes to every task, and with several blocks their findings are merged by row.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    return _found(docs, benchmark, block_words).drop("row")


def without_contamination(documents: DataFrame, benchmark: DataFrame, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with the hit words cut out of their texts, each run leaving a space; those with more than max_share of their words hit are removed.

    All columns of documents are kept, whatever their names; n_chars, where it is there, is counted anew for texts that were cut. Null and empty texts stay as they are; texts of any length are searched and cut whole; repeated rows are cut each for itself; without items, or without documents, nothing changes.
    """
    bounded_batches(documents.sparkSession)
    docs = packed(documents).withColumn("row", F.monotonically_increasing_id())
    first, more = _first_block(benchmark, block_words)
    if more:
        docs = written(docs)
        cut = _cut(docs.join(_found(docs, benchmark, block_words).select("row", "n_words", "n_hit", "hits"), "row"), None)
    else:
        cut = _cut(docs, _task(docs, first))
    cut = cut.where(F.col("n_hit") <= max_share * F.col("n_words"))
    replaced = {}
    if "n_chars" in documents.columns:
        replaced["n_chars"] = F.when(F.col("n_hit") > 0, F.char_length("text")).otherwise(packed_column(documents.columns, "n_chars")).cast(documents.schema["n_chars"].dataType)
    return unpacked(cut, documents.columns, **replaced)


def _found(docs: DataFrame, benchmark: DataFrame, block_words: int) -> DataFrame:
    first, more = _first_block(benchmark, block_words)
    if not more:
        return _searched(docs, first)
    docs = written(docs)
    # a block's findings are written before the next block is read
    parts = [written(_searched(docs, block)) for block in _blocks(benchmark, block_words)]
    whole = functools.reduce(DataFrame.unionByName, parts)
    whole = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return whole.mapInArrow(_merged, whole.select("row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), "item_ids", "hits").schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The findings of all blocks in a document: runs that meet become one."""
    for batch in batches:
        n_hit, named, spans = [], [], []
        for found, ids in zip(batch.column("hits").to_pylist(), batch.column("item_ids").to_pylist(), strict=True):
            own: list[dict] = []
            for x in found:
                if own and own[-1]["end"] >= x["first"]:
                    own[-1]["end"] = max(own[-1]["end"], x["end"])
                else:
                    own.append(x)
            spans.append(own)
            named.append(sorted(set(ids)))
            n_hit.append(sum(x["end"] - x["first"] for x in own))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words")), pa.array(n_hit, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))], names=["row", "doc_id", "n_words", "n_hit", "item_ids", "hits"])


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items one block after another; the driver holds a block and a partition at most."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").toLocalIterator():
        n = len(item_words(r["text"]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        if n:
            block.append((r["item_id"], r["text"]))
            size += n
    if block:
        yield block


def _first_block(benchmark: DataFrame, block_words: int) -> tuple[list[tuple[str, str]], bool]:
    """The first block of items (empty if there is none), and whether there are more."""
    blocks = _blocks(benchmark, block_words)
    return next(blocks, []), next(blocks, None) is not None


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


#: A worker keeps the automaton that it built last, for its next task.
_BUILT: dict[str, Items] = {}


def _task(docs: DataFrame, block: list[tuple[str, str]]):
    sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def task() -> Items:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Items(sent.value)
        return _BUILT[name]

    return task


def _spans(items: Items, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    hit, counts, found, bounds = items.search(chunk)
    n_hit, named, spans = np.zeros(chunk.n, np.int64), [[] for _ in range(chunk.n)], [[] for _ in range(chunk.n)]
    for i, ks in found.items():
        own = hit[bounds[i] : bounds[i + 1]]
        edges = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        n_hit[i] = own.sum()
        spans[i] = [{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True)]
        named[i] = sorted({items.ids[k] for k in ks if items.ids[k] is not None})
    return counts, n_hit, named, spans


def _searched(docs: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    task = _task(docs, block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = task()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                counts, n_hit, named, spans = _spans(items, chunk)
                row, doc_id = (batch.column(c).slice(chunk.first, chunk.n) for c in ("row", "doc_id"))
                yield pa.RecordBatch.from_arrays([row, doc_id, pa.array(counts, pa.int64()), pa.array(n_hit), pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))], names=["row", "doc_id", "n_words", "n_hit", "item_ids", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(search, f"row long, doc_id {kind}, n_words long, n_hit long, item_ids array<string>, hits array<struct<first:long,end:long>>")


def _cut(docs: DataFrame, task) -> DataFrame:
    """docs with the hit words out of text; the hits come from docs, or are searched for by a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = task and task()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                own = batch.slice(chunk.first, chunk.n)
                if items:
                    counts, n_hit, _, spans = _spans(items, chunk)
                else:
                    counts, n_hit, spans = (own.column(c).to_pylist() for c in ("n_words", "n_hit", "hits"))
                texts = own.column("text").to_pylist()
                words = chunk.words(ENDS_WORD) if any(spans) else None
                for i, found in enumerate(spans):
                    if found:
                        text, at, out = chunk.text(i), 0, []
                        base, first = int(chunk.offsets[i]), int(words.bounds[i])
                        for x in found:
                            out.append(text[at : int(words.starts[first + x["first"]]) - base])
                            at = int(words.ends[first + x["end"] - 1]) - base
                        texts[i] = b" ".join([*out, text[at:]]).decode()
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(texts, pa.string()), own.column("rest__"), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64())], names=["doc_id", "text", "rest__", "n_words", "n_hit"])

    zero = F.lit(0).cast("long")
    return docs.mapInArrow(cut, docs.select("doc_id", "text", "rest__", zero.alias("n_words"), zero.alias("n_hit")).schema)


def digest(found: DataFrame) -> DataFrame:
    """The findings as counts and a hash of the items."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

