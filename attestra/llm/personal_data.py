"""Personal data in texts: fixed patterns, and identifiers that bootstrapped contexts give away.

The matches of the fixed patterns are seeds. A lexical pattern is the words before and after a string that looks like an identifier, whatever its shape; patterns and the instances they enclose form a bipartite graph. Round by round Spark scores patterns by the trust in their instances and instances by the patterns that enclose them; what highly trusted patterns enclose is reported too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from attestra.llm.shared_tables import bounded_batches, named, packed, packed_column, unpacked, written
from attestra.llm.spans import SPAN, SPAN_SQL, code_points, document_of, joined_spans, of_kind
from attestra.llm.text_arrays import Chunk, Words, chunks, members

KINDS = ("email", "ip", "card", "phone", "context")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: Rounds of scoring; a pattern's share of trusted instances, and distinct seeds, from which it discovers others.
ROUNDS, TRUST, SEEDS = 3, 0.8, 3
#: Characters and digits from which a string is like an identifier.
LEAST, DIGITS = 6, 3

_LOCAL = members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = members(b"0123456789")
_SEPARATOR = members(b" -")
_TRIM = b".,;:!?()[]{}\"'"
_PUNCTUATION = members(_TRIM)


def luhn(digits: bytes) -> bool:
    odd, even = sum(x - 48 for x in digits[::-1][::2]), sum(sum(divmod(2 * (x - 48), 10)) for x in digits[::-1][1::2])
    return (odd + even) % 10 == 0


def _emails(chunk: Chunk, text: bytes) -> Iterator[tuple[int, int, int]]:
    bounds = np.concatenate([[0], np.flatnonzero(~_LOCAL[chunk.data]) + 1])
    last_end = 0
    signs = np.flatnonzero(chunk.data == ord("@"))
    for at, i in zip(signs.tolist(), document_of(chunk, signs).tolist(), strict=True):
        begin = max(last_end, int(bounds[np.searchsorted(bounds, at, "right") - 1]), int(chunk.offsets[i]))
        m = DOMAIN.match(text, at + 1, int(chunk.offsets[i + 1])) if begin < at else None
        if m:
            last_end = m.end()
            yield i, begin, last_end


def _addresses(chunk: Chunk, digit: np.ndarray, total: np.ndarray, text: bytes) -> Iterator[tuple[int, int, int]]:
    dots = np.flatnonzero(chunk.data == ord("."))
    dots = dots[(dots > 0) & (dots < len(chunk.data) - 1)]
    dots = dots[digit[dots - 1] & digit[dots + 1]]
    docs = document_of(chunk, dots)
    inside = (dots > chunk.offsets[docs]) & (dots + 1 < chunk.offsets[docs + 1])
    dots, docs = dots[inside], docs[inside]
    if len(dots) < 3:
        return
    linked = (np.diff(total[dots]) == np.diff(dots) - 1) & (docs[1:] == docs[:-1])
    firsts = np.flatnonzero(np.concatenate([[True], ~linked]))
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(dots)], strict=True):
        for k in range(a, b - 2, 4):  # four parts, and the dot after them belongs to none
            first, last = int(chunk.offsets[docs[k]]), int(chunk.offsets[docs[k] + 1])
            begin, end = int(dots[k]), int(dots[k + 2]) + 1
            while begin > first and digit[begin - 1]:
                begin -= 1
            while end < last and digit[end]:
                end += 1
            parts = [x.lstrip(b"0") for x in text[begin:end].split(b".")]
            if all(len(x) < 4 and int(x or b"0") <= 255 for x in parts):
                yield int(docs[k]), begin, end


def _cards(chunk: Chunk, at: np.ndarray, text: bytes) -> Iterator[tuple[int, int, int]]:
    """at: the positions of all digits."""
    if not len(at):
        return
    gap, docs = np.diff(at), document_of(chunk, at)
    linked = ((gap == 1) | ((gap == 2) & _SEPARATOR[chunk.data[at[:-1] + 1]])) & (docs[1:] == docs[:-1])
    firsts = np.flatnonzero(np.concatenate([[True], ~linked]))
    count = np.diff(np.concatenate([firsts, [len(at)]]))
    for a, n in zip(firsts[(count >= 12) & (count <= 19)].tolist(), count[(count >= 12) & (count <= 19)].tolist(), strict=True):
        if luhn(chunk.data[at[a : a + n]].tobytes()):
            yield int(docs[a]), int(at[a]), int(at[a + n - 1]) + 1


def _phones(chunk: Chunk, digit: np.ndarray, text: bytes) -> Iterator[tuple[int, int, int]]:
    signs = np.flatnonzero(chunk.data[:-1] == ord("+")) if len(chunk.data) else np.zeros(0, int)
    signs = signs[digit[signs + 1]]
    for at, i in zip(signs.tolist(), document_of(chunk, signs).tolist(), strict=True):
        m = PHONE.match(text, at, int(chunk.offsets[i + 1]))
        if m and 9 <= sum(48 <= x <= 57 for x in m[0]) <= 15:
            yield i, at, m.end()


def base_spans(chunk: Chunk) -> list[list[tuple[int, int, int]]]:
    """By document: (begin, rank of the kind, end) in bytes from the document's start."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.n)]
    text, digit = chunk.data.tobytes(), _DIGIT[chunk.data]
    at = np.flatnonzero(digit)
    total = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
    for rank, found in enumerate((_emails(chunk, text), _addresses(chunk, digit, total, text), _cards(chunk, at, text), _phones(chunk, digit, text))):
        for i, a, b in found:
            out[i].append((a - int(chunk.offsets[i]), rank, b - int(chunk.offsets[i])))
    return out


def _identifier_like(chunk: Chunk, words: Words, base: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the strings that look like identifiers: runs of words, one space apart, with a digit or an at sign each, and DIGITS digits or an at sign in all. Words that touch a fixed pattern's match, and punctuation between two words, end a run."""
    n, data = len(words.starts), chunk.data
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    digits, signs = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (_DIGIT[data], data == ord("@")))
    digits, signs = (x[words.ends] - x[words.starts] for x in (digits, signs))
    like = (digits > 0) | (signs > 0)
    for i, spans in enumerate(base):
        for a, _, b in spans:
            first = int(chunk.offsets[i])
            like[np.searchsorted(words.ends, a + first, "right") : np.searchsorted(words.starts, b + first)] = False
    linked = like[1:] & like[:-1] & (words.starts[1:] - words.ends[:-1] == 1) & (data[words.ends[:-1]] == 0x20)
    linked &= ~_PUNCTUATION[data[words.ends[:-1] - 1]] & ~_PUNCTUATION[data[words.starts[1:]]]
    linked[words.bounds[1:-1][(words.bounds[1:-1] > 0) & (words.bounds[1:-1] < n)] - 1] = False
    begins = np.flatnonzero(like & np.concatenate([[True], ~linked]))
    ends = np.flatnonzero(like & np.concatenate([~linked, [True]]))
    total_digits, total_signs = (np.concatenate([[0], np.cumsum(x)]) for x in (digits, signs))
    enough = (total_digits[ends + 1] - total_digits[begins] >= DIGITS) | (total_signs[ends + 1] > total_signs[begins])
    return begins[enough], ends[enough]


def candidates(chunk: Chunk, base: list[list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, bytes, bytes, bool]]:
    """(document, begin, end, pattern, instance, is it a seed) of the strings that look like identifiers, of any length, and the seeds. The pattern is the word before and the word after."""
    words = chunk.words()
    text, n = chunk.data.tobytes(), len(words.starts)
    picked: list[tuple[int, int, int, bool]] = []
    for i, spans in enumerate(base):
        picked += [(i, a + int(chunk.offsets[i]), b + int(chunk.offsets[i]), True) for a, _, b in spans]
    firsts, lasts = _identifier_like(chunk, words, base)
    for i, k, m in zip(document_of(chunk, words.starts[firsts]).tolist(), firsts.tolist(), lasts.tolist(), strict=True):
        a, b = int(words.starts[k]), int(words.ends[m])
        core = text[a:b].lstrip(_TRIM)
        a = b - len(core)
        b = a + len(core.rstrip(_TRIM))
        if b - a >= LEAST:
            picked.append((i, a, b, False))
    for i, a, b, seed in picked:
        k, m = int(np.searchsorted(words.ends, a, "right")), int(np.searchsorted(words.starts, b))
        # a word that the span begins or ends within counts as far as it reaches
        left = text[words.starts[k] : a] if k < n and words.starts[k] < a else text[words.starts[k - 1] : words.ends[k - 1]] if k > words.bounds[i] else b"^"
        cut = m - 1
        right = text[b : words.ends[cut]].strip(_TRIM) if 0 <= cut < n and words.ends[cut] > b else b""
        right = right or (text[words.starts[m] : words.ends[m]] if m < words.bounds[i + 1] else b"$")
        yield i, a, b, left.lower() + b" " + right.lower(), text[a:b], seed


_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.binary()), ("instance", pa.binary()), ("seed", pa.bool_())])
_CANDIDATE_SQL = "array<struct<start:long,end:long,pattern:binary,instance:binary,seed:boolean>>"


def _search(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            base = base_spans(chunk)
            near: list[list[dict]] = [[] for _ in range(chunk.n)]
            places = [code_points(chunk.text(i)) if spans else None for i, spans in enumerate(base)]
            for i, a, b, pattern, instance, seed in candidates(chunk, base):
                first = int(chunk.offsets[i])
                if places[i] is None:
                    places[i] = code_points(chunk.text(i))
                p = places[i]
                a, b = (a - first, b - first) if p is None else (int(p[a - first]), int(p[b - first]))
                near[i].append({"start": a, "end": b, "pattern": pattern, "instance": instance, "seed": seed})
            spans = [[{"start": a if p is None else int(p[a]), "rank": k, "kind": KINDS[k], "end": b if p is None else int(p[b])} for a, k, b in sorted(found)] for found, p in zip(base, places, strict=True)]
            own = batch.slice(chunk.first, chunk.n).select(kept)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(spans, pa.list_(SPAN)), pa.array(near, pa.list_(_CANDIDATE))], names=[*own.schema.names, "spans", "near__"])


def trusted_patterns(candidates: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """Patterns of score at least `trust` after the rounds, from candidates (pattern, instance, seed).

    A pattern's score is the trust in its distinct instances over their number and one more; an instance that is no seed is trusted as far as one of its patterns errs never: 1 less the product of what each leaves in doubt. Patterns that enclose fewer than `seeds` distinct seeds score 0.
    """
    edges = written(candidates.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeded = edges.where("seed").groupBy("pattern").agg(F.count("*").alias("n_seeds")).where(F.col("n_seeds") >= seeds)
    edges = written(edges.join(seeded, "pattern").select("pattern", "instance", "seed", "n_seeds"))  # no other pattern can score
    belief = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scored = edges.withColumn("belief", belief).groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 1)).alias("score"))
    for _ in range(rounds - 1):
        doubt = edges.where("NOT seed").join(scored, "pattern").groupBy("instance").agg(F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))).alias("doubt"))
        scored = written(edges.join(doubt, "instance", "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(1 - F.coalesce("doubt", F.lit(1.0)))).groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 1)).alias("score")))
    return scored.where(F.col("score") >= trust).select("pattern")


def with_personal_data(documents: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS, keep_text: bool = True) -> DataFrame:
    """documents with one more column, spans: (start, rank and kind, end) in code points; without text, if that is not to be kept.

    documents: doc_id and text; other columns are kept, and ones named spans, near__, row__ or added__ are replaced. A null or empty text has no spans. Repeated rows are searched each for itself, but count once for the patterns; a null doc_id is carried through; an empty table gives an empty result. What the contexts add overlaps no match of the fixed patterns.
    """
    bounded_batches(documents.sparkSession)
    own = documents.drop("spans", "near__", "row__", "added__")
    kept = [c for c in own.columns if keep_text or c != "text"]
    schema = StructType([StructField(c, own.schema[c].dataType) for c in kept])
    for field in StructType.fromDDL(f"spans {SPAN_SQL}, near__ {_CANDIDATE_SQL}"):
        schema = schema.add(field)
    found = own.mapInArrow(lambda batches: _search(batches, kept), schema)
    found = written(found.withColumn("row__", F.monotonically_increasing_id()))
    near = found.where(F.size("near__") > 0).select("row__", F.explode("near__").alias("c")).select("row__", "c.*")
    patterns = trusted_patterns(near.select("pattern", "instance", "seed"), rounds, trust, seeds)
    added = near.where("NOT seed").join(patterns, "pattern", "left_semi").groupBy("row__").agg(F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), F.lit(KINDS[-1]).alias("kind"), "end")).alias("added__"))
    both = found.join(added, "row__", "left")
    return both.select(*map(named, kept), F.array_sort(F.when(F.col("added__").isNull(), F.col("spans")).otherwise(F.concat("spans", "added__"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the fixed patterns' spans, and all spans as a string."""
    n = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    return found.select("doc_id", *n[:4], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), n[4])


def masked(documents: DataFrame) -> DataFrame:
    """documents with each span of personal data in text replaced by its kind in angle brackets; n_chars, where it is there, is counted anew for those texts.

    Overlapping spans are replaced together, by the first one's kind. documents: doc_id and text; all other columns are kept, whatever their names. A null text stays null, an empty one empty; texts of any length are masked whole; repeated rows are masked each for itself; an empty table gives an empty result.
    """
    found = with_personal_data(packed(documents))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, text).otherwise(F.col("text"))
    changed = found.withColumn("masked", text)
    replaced = {"text": F.col("masked")}
    if "n_chars" in documents.columns:
        replaced["n_chars"] = F.when(F.size("spans") > 0, F.char_length("masked")).otherwise(packed_column(documents.columns, "n_chars")).cast(documents.schema["n_chars"].dataType)
    return unpacked(changed, documents.columns, **replaced)
