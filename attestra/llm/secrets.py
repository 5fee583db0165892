"""Secrets in texts: fixed patterns, and strings that neither their surroundings nor a dictionary of identifiers help to compress.

A candidate is a long run of letters, digits and a few signs with a sensitive word shortly before it; one of letters of one case or of digits alone must be longer than others. zstandard, primed with a dictionary of common identifiers followed by the text around the candidate, tells how many bytes it adds: code, words and repeated names cost little, random keys about their information content. Those above a share of their length are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches
from attestra.llm.spans import SPAN, SPAN_SQL, code_points, document_of, joined_spans, of_kind, runs
from attestra.llm.text_arrays import Chunk, chunks, members

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SENSITIVE = re.compile(rb"(?i:pass|pwd|secret|token|key|auth|bearer|credential|private|signature|login|session)")
#: Of novel strings: length, bytes before them in which a sensitive word counts, bytes on either side of them that prime the compressor, added bytes per byte.
LEAST, NEAR, AROUND, NOVELTY = 16, 40, 256, 0.6
#: Letters of one case (but a capital in front) and digits alone are words and numbers as often as keys; zstandard stores so few bytes as they are, and only from this length on tells the two apart. (So many digits match a fixed pattern anyway.)
LEAST_PLAIN = 40
#: Fixed text that primes the compressor: names and phrases that are no secrets.
IDENTIFIERS = (
    b"password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    b"authorization bearer basic session cookie username user_name login logout signature credential certificate "
    b"https://www.example.com/ http://localhost:8080/ index.html config.json settings.yaml "
    b"import return class function public static final void string integer boolean default private protected "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx 1234567890123456 "
    b"your_password_here changeme example placeholder undefined null none true false "
)
_WORDY = members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_SMALL, _GREAT = members(b"abcdefghijklmnopqrstuvwxyz"), members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX, _DIGIT = members(b"0123456789abcdef"), members(b"0123456789")
_ACCESS = members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_CASE = np.arange(256, dtype=np.uint8)
_CASE[0x41:0x5B] += 32


def _assigned(chunk: Chunk, low: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, begin, end) of the assignments; only documents with a keyword's first three letters are searched."""
    loads = np.ndarray((len(low) - 3,), "<u4", low, strides=(1,)) & np.uint32(0xFFFFFF)
    at = np.concatenate([np.flatnonzero(loads == int.from_bytes(x, "little")) for x in (b"pas", b"sec", b"tok", b"api")])
    for i in np.unique(document_of(chunk, at)).tolist():
        for m in ASSIGN.finditer(chunk.text(i)):
            if m.end(1) - m.start(1) >= 8:
                yield i, m.start(), m.end()


def added_bytes(before: bytes, candidate: bytes, after: bytes) -> int:
    """Compressed bytes that the candidate adds to what stands around it, with the dictionary of identifiers."""
    # priming holds the surroundings too, and so nothing but the candidate is paid for
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + after + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(press.compress(candidate)) - len(press.compress(b""))


def _novel(chunk: Chunk) -> Iterator[tuple[int, int, int]]:
    digits, small, great = (np.concatenate([[0], np.cumsum(x[chunk.data], dtype=np.int64)]) for x in (_DIGIT, _SMALL, _GREAT))
    found = runs(_WORDY[chunk.data], chunk.offsets, LEAST)
    a, b = found[:, 0], found[:, 1]
    n_digits, mixed = digits[b] - digits[a], (small[b] > small[a]) & (great[b] > great[a + 1])
    found = found[(n_digits > 0) & (n_digits < b - a) | mixed | (b - a >= LEAST_PLAIN)]
    for i, (begin, end) in zip(document_of(chunk, found[:, 0]).tolist(), found.tolist(), strict=True):
        first, last = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
        word, name, value = chunk.data[begin:end].tobytes(), b"", b""
        name, sign, value = word.partition(b"=")
        if sign and len(value.strip(b"=")) >= LEAST and SENSITIVE.search(name):  # name=value without spaces
            begin, word = end - len(value), value
        near = chunk.data[max(first, begin - NEAR) : begin].tobytes()
        if not SENSITIVE.search(near):
            continue
        before, after = chunk.data[max(first, begin - AROUND) : begin].tobytes(), chunk.data[end : min(last, end + AROUND)].tobytes()
        if added_bytes(before, word, after) >= NOVELTY * len(word):
            yield i, begin - first, end - first


def found_in(chunk: Chunk) -> list[list[tuple[int, int, int]]]:
    """By document: (begin, rank of the kind, end) in bytes."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.n)]
    low = _CASE[chunk.padded]
    for i, a, b in _assigned(chunk, low):
        out[i].append((a, 0, b))
    starts = np.flatnonzero(np.ndarray((len(chunk.padded) - 3,), "<u4", chunk.padded, strides=(1,)) == int.from_bytes(b"AKIA", "little"))
    last_end = -1
    for at in starts.tolist():
        i = int(document_of(chunk, np.array([at]))[0])
        limit = int(chunk.offsets[i + 1])
        if at < last_end or at + 4 > limit:
            continue
        end = at + 4
        while end < limit and _ACCESS[chunk.data[end]]:
            end += 1
        if end > at + 4:
            last_end = end
            if end - at >= 16:
                out[i].append((at - int(chunk.offsets[i]), 1, end - int(chunk.offsets[i])))
    found = runs(_HEX[chunk.data], chunk.offsets, 32)
    for i, (a, b) in zip(document_of(chunk, found[:, 0]).tolist(), found.tolist(), strict=True):
        out[i].append((a - int(chunk.offsets[i]), 2, b - int(chunk.offsets[i])))
    for i, a, b in _novel(chunk):
        if all(b <= x or y <= a for x, _, y in out[i]):  # base matches stay as they are
            out[i].append((a, 3, b))
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            rows = []
            for i, found in enumerate(found_in(chunk)):
                points = code_points(chunk.text(i)) if found else None
                place = (lambda x: x) if points is None else (lambda x, p=points: int(p[x]))
                rows.append([{"start": place(a), "rank": k, "kind": KINDS[k], "end": place(b)} for a, k, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, chunk.n), pa.array(rows, pa.list_(SPAN))], names=["doc_id", "spans"])


def secrets(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans (start, rank and kind, end; code points, by start).

    Of documents, doc_id and text count. A null or empty text has no spans; texts of any length are searched whole; repeated rows are searched each for itself; a null doc_id is carried through; an empty table gives an empty result. Matches of one kind never overlap; novel strings never overlap with matches of the fixed patterns.
    """
    bounded_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_search, f"doc_id {kind}, spans {SPAN_SQL}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the fixed patterns' spans, and all spans as a string."""
    n = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select("doc_id", *n[:3], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), n[3])
