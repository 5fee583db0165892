"""Weak supervision of document quality.

Rules look at one document each and vote good, bad or abstain. Expectation-maximisation over all documents' votes learns, without labels, how often each rule casts each vote on good and on bad documents; a document is kept if its posterior probability of being good is high enough. The votes of all documents enter as counts by vote pattern, of which there are 3 to the number of rules at most, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches, written
from attestra.llm.text_arrays import Chunk, chunks, covered, members

#: name, whether a high value is bad, votes bad beyond the first bound, votes good within the second.
RULES = (
    ("symbols_per_word", True, 0.30, 0.05),
    ("repeat_share", True, 0.30, 0.05),
    ("dup_line_share", True, 0.50, 0.25),
    ("caps_share", True, 0.40, 0.10),
    ("distinct_share", False, 0.30, 0.45),
    ("short_share", False, 0.08, 0.15),
    ("sentence_share", False, 0.01, 0.03),
    ("exclaim_per_word", True, 0.40, 0.10),
    ("digit_share", True, 0.40, 0.10),
)
#: Below so many words the shares say little: the rules abstain, except the first.
FEW_WORDS = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_distinct", "n_short", "n_sentence", "n_exclaim", "n_digits")

_SYMBOL, _EXCLAIM, _DIGIT = members(b"#*$%&|<>"), members(b"!"), members(b"0123456789")
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True
_STOP, _LETTER = members(b".,;:?!"), members(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_UPPER, _LOWER = members(bytes(range(0x41, 0x5B))), members(bytes(range(0x61, 0x7B)))


def _dup_lines(text: bytes) -> tuple[int, int]:
    if b"\n" not in text:
        return 0, int(bool(text.strip()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def counted(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk."""
    words = chunk.words()
    data, h, docs = chunk.data, words.hashes(), words.docs()
    at, windows = words.windows(h, 8)
    order = np.lexsort((windows, docs[at]))
    same = (windows[order][1:] == windows[order][:-1]) & (docs[at][order][1:] == docs[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    order = np.lexsort((h, docs))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    n_upper, n_lower, n_letters = (x[words.ends] - x[words.starts] for x in (np.concatenate([[0], np.cumsum(x[data], dtype=np.int64)]) for x in (_UPPER, _LOWER, _LETTER)))
    length, last = words.ends - words.starts, words.ends - 1
    lines = np.array([_dup_lines(chunk.text(i)) for i in range(chunk.n)], np.int64).reshape(-1, 2)
    return {
        "n_words": words.counts,
        "word_chars": chunk.sums(~words.white & ~_CONTINUED[data]),
        "n_symbols": chunk.sums(_SYMBOL[data]),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": words.sums(covered(at[twice], 8, len(h))),
        "n_lines": lines[:, 1],
        "n_caps": words.sums((n_upper >= 2) & (n_lower == 0)),
        "n_distinct": words.sums(fresh),
        "n_short": words.sums((length <= 4) & (n_letters == length)),
        "n_sentence": words.sums(_STOP[data[last]] & (length > 1) & _LETTER[data[np.maximum(last - 1, 0)]]),
        "n_exclaim": chunk.sums(_EXCLAIM[data]),
        "n_digits": chunk.sums(_DIGIT[data]),
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            found = counted(chunk)
            ids = batch.column("doc_id").slice(chunk.first, chunk.n)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[x], pa.int64()) for x in COUNTS)], names=["doc_id", *COUNTS])


def document_counts(documents: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; a null text has no words."""
    bounded_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_count_batches, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in COUNTS))


def with_votes(counts: DataFrame) -> DataFrame:
    """Adds votes: for each rule 0 (abstain), 1 (bad) or 2 (good)."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    shares = {
        "symbols_per_word": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "caps_share": F.col("n_caps") / n,
        "distinct_share": F.col("n_distinct") / n,
        "short_share": F.col("n_short") / n,
        "sentence_share": F.col("n_sentence") / n,
        "exclaim_per_word": F.col("n_exclaim") / n,
        "digit_share": F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)),
    }
    votes = []
    for name, high_is_bad, bad, good in RULES:
        x = shares[name]
        says_bad, says_good = (x > bad, x <= good) if high_is_bad else (x < bad, x >= good)
        few = F.col("n_words") < (1 if name == "symbols_per_word" else FEW_WORDS)
        votes.append(F.when(few, 0).when(says_bad, 1).when(says_good, 2).otherwise(0))
    return counts.withColumn("votes", F.array(*votes))


def learn_rules(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, strength: float = 0.01) -> tuple[float, np.ndarray]:
    """Expectation-maximisation: the share of good documents, and by class (bad, good) and rule the probability of each vote.

    patterns: one row of votes for each distinct pattern, weights: its documents. A prior worth a share `strength` of all documents says that rules err seldom on good documents and often abstain from the truth on bad ones; it keeps the two classes from changing places.
    """
    total = max(float(weights.sum()), 1.0)
    votes = np.stack([patterns == v for v in range(3)], 2).astype(float)
    prior = np.stack([np.tile([0.1, 0.4, 0.5], (patterns.shape[1], 1)), np.tile([0.1, 0.01, 0.89], (patterns.shape[1], 1))])
    n_bad = (patterns == 1).sum(1)
    good = np.where(n_bad == 0, 0.95, 0.1)
    share, table = 0.5, prior
    for _ in range(rounds):
        mass = np.stack([weights * (1 - good), weights * good])
        table = np.einsum("cp,prv->crv", mass, votes) + prior * strength * total
        table /= table.sum(2, keepdims=True)
        share = (mass[1].sum() + 0.5) / (total + 1)
        new = posterior(patterns, share, table)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability that a document of each pattern is good."""
    log = np.log(table)
    at = np.arange(patterns.shape[1])
    odds = np.log(share / (1 - share)) + (log[1][at, patterns] - log[0][at, patterns]).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def quality_rules(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: its counts, base_failed, votes, p_good and kept.

    documents: doc_id and text; other columns are ignored. A null or empty text has no words and fails the base rule. Repeated rows are scored each for itself; a null doc_id is carried through. An empty table gives an empty result.
    """
    counts = written(with_votes(document_counts(documents)))
    seen = counts.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    patterns = np.array([r["votes"] for r in seen], int).reshape(-1, len(RULES))
    share, table = learn_rules(patterns, np.array([r["count"] for r in seen], float))
    log = np.log(table)
    gain = np.clip(log[1] - log[0], -50, 50)
    odds = F.lit(float(np.log(share / (1 - share))))
    for j in range(len(RULES)):
        odds = odds + F.element_at(F.array(*(F.lit(float(x)) for x in gain[j])), F.element_at("votes", j + 1) + 1)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
