"""Token counts under a unigram vocabulary, without making the tokens.

A text is cut at spaces into words, each with the word-start sign before it; an Aho-Corasick automaton lists all vocabulary pieces in a word, and dynamic programming carries, for each end, the best score and the number of pieces on the way to it. Ties go to the longest last piece, as in the forward search of the public unigram tokenizers. Equal words are counted once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches
from attestra.llm.text_arrays import Chunk, chunks, joined, members, mix

SIGN = "▁"
#: What a character without a piece costs below the worst piece: a fixed value of the public unigram tokenizers.
UNKNOWN_PENALTY = 10.0
#: Fixed names of pieces that stand for no characters.
SPECIAL = frozenset(("<unk>", "<s>", "</s>", "<pad>"))
#: Words whose counts a worker keeps at most; it forgets them all beyond that.
KEPT_WORDS = 400_000

#: Characters that no piece may have: words end at them, and each is a token.
BYTE = re.compile("<0x[0-9A-F]{2}>")
_HARD = members(b"\t\n")
_ENDS = _HARD.copy()
_ENDS[0x20] = True


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with byte pieces, in their order, scored by Zipf's law: the r-th has probability in proportion to 1/r."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    missing = [b for b in range(256) if f"<0x{b:02X}>" not in pieces]
    if missing:
        raise ValueError(f"{path} lacks byte pieces, for example {missing[0]}")
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    special = {i for i in range(len(pieces)) if model.is_control(i) or model.is_unknown(i)}
    if odd := {pieces[i] for i in special} - SPECIAL:
        raise ValueError(f"{path} has special pieces of unknown names, for example {min(odd)}")
    return [(p, 0.0 if i in special else -math.log(i + 1) - total) for i, p in enumerate(pieces)]


class Counter:
    """Counts the pieces of words. Special pieces (by their names) and byte pieces are never matched in a text's characters; all others are, whatever their score."""

    def __init__(self, pieces: list[tuple[str, float]]):
        pieces = [(p, s) for p, s in pieces if p not in SPECIAL]
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if not BYTE.fullmatch(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces if not BYTE.fullmatch(p)), default=1)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        if any(c in p for p, _ in pieces for c in "\t\n"):
            raise ValueError("pieces with tabs or line ends are not supported")
        self.known: dict[int, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best way to cut a word; scores and counts are held for as many ends as the longest piece has characters, whatever the word's length."""
        n, ring = len(word), self.longest + 1
        best, pieces = [-math.inf] * ring, [0] * ring
        best[0] = 0.0
        matches, single = self.automaton.iter(word), self.single
        last, match = next(matches, (n, None))
        for end in range(1, n + 1):
            top, at, count = -math.inf, 0, 0
            while last == end - 1:
                length, score = match
                i = end - length
                total = best[i % ring] + score
                if total > top or total == top and i < at:
                    top, at, count = total, i, pieces[i % ring] + 1
                last, match = next(matches, (n, None))
            if word[end - 1] not in single:
                total = best[(end - 1) % ring] + self.unknown
                if total > top:
                    top, count = total, pieces[(end - 1) % ring] + len(word[end - 1].encode())
            best[end % ring], pieces[end % ring] = top, count
        return pieces[n % ring]

    def counts(self, chunk: Chunk) -> np.ndarray:
        """Tokens of each document of a chunk."""
        if SIGN.encode() in chunk.data.tobytes():  # in a text the sign is as good as a space
            texts = [chunk.text(i).replace(SIGN.encode(), b" ") for i in range(chunk.n)]
            chunk = Chunk(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), chunk.first)
        data, offsets = chunk.data, chunk.offsets
        words = chunk.words(_ENDS)
        first = np.isin(words.starts, offsets[:-1])
        signed = first | (data[np.maximum(words.starts - 1, 0)] == 0x20)
        h = joined(words.hashes(), mix(signed.astype(np.uint64)))
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, sizes = self.known, np.zeros(len(unique), np.int64)
        for k, (key, at) in enumerate(zip(unique.tolist(), where.tolist(), strict=True)):
            n = known.get(key)
            if n is None:
                text = data[words.starts[at] : words.ends[at]].tobytes().decode()
                n = known[key] = self.word(SIGN + text if signed[at] else text)
            sizes[k] = n
        out = words.sums(sizes[back]) + chunk.sums(_HARD[data])
        # a sign that no word follows is a token itself; so is the one before a text that begins with no space
        lone = data == 0x20
        follows = np.ones(len(data) + 1, bool)
        follows[:-1] = _ENDS[data]
        follows[offsets] = True
        filled = offsets[:-1] < offsets[1:]
        heads = data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(chunk.n, np.uint8)
        return out + chunk.sums(lone & follows[1:]) + (filled & _HARD[heads])


_COUNTERS: dict[int, Counter] = {}


def token_counts(documents: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """One row per document: doc_id, n_bytes and n_tokens of the whole text.

    documents: doc_id and text; other columns are ignored. A null or empty text has no tokens; repeated rows are counted each for itself; a null doc_id is carried through; an empty table gives an empty result. A text of any length is counted whole, word by word. pieces: a vocabulary of fixed size, which goes to every task. Characters without a piece count as their bytes. Of ways to cut a word that score the same, the one with the longest last piece counts. Every space starts a word, so that each of several spaces is a piece of its own, even where the vocabulary has pieces of several word-start signs.
    """
    bounded_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sent.value))
        counter = _COUNTERS.get(key)
        if counter is None:
            counter = _COUNTERS[key] = Counter(sent.value)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(chunk.offsets), pa.int64()), pa.array(counter.counts(chunk), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
