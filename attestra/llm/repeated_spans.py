"""Removal of byte strings that occur in an earlier document, by deep-shallow sorting.

Each string of WIDTH bytes belongs to the least hash among its GRAM-byte grams, so that equal strings belong together wherever they stand. Neighbouring strings of the same least hash form a run. A first exchange tells which hashes several documents have; the text of only those runs is then dealt out by hash, sorted, and compared: first whole runs, and where a hash has several different ones, their strings one by one. Runs that a chunk of documents has several times leave it once.

Every chunk sends a row to nearly every part, and both grow in number with the input. Chunks are large, so that these rows are few and long, and their runs are found piece by piece.

No task gets all that share a hash, however often it occurs. What chunks offer is combined for FAN chunks at a time before the parts see it. A hash of very many runs is split into shares by the content of its strings, so that equal ones still meet; a share's strings, too, are sorted and reduced to different ones for FAN chunks at a time before all of a share are sorted.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.shared_tables import bounded_batches, row_names, written
from attestra.llm.suffix_order import ranks
from attestra.llm.text_arrays import chunks, covered, joined, mix

WIDTH, GRAM = 50, 16
#: Bytes of documents in a chunk and in a piece of it, and of all documents for each part that the hashes are dealt into.
CHUNK, PIECE, PART = 16 << 20, 2 << 20, 8 << 20
#: Strings of split hashes that are sorted at a time, and bytes of a batch that leaves Python.
STRINGS, BATCH = 1 << 20, 4 << 20
#: Runs of a hash that make a share of it, some 20 MB of text, and chunks whose rows meet in one group.
SHARE, FAN = 200_000, 4096
_LATER = np.iinfo(np.int64).max


@functools.cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def packed(x: np.ndarray | bytes, level: int = 3) -> bytes:
    return _compressor(level).compress(x if isinstance(x, bytes) else x.tobytes())


def unpacked(x: bytes, kind: str | type = np.uint8) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(x), kind)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, ids, texts, sizes = row_names(), [], [], []

    def row() -> pa.RecordBatch:
        data, offsets = b"".join(texts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        out = pa.RecordBatch.from_arrays([pa.array([next(names)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(data)], pa.int64()), pa.array([packed(offsets.astype("<i8"))], pa.binary()), pa.array([packed(data, 6)], pa.binary())], names=["chunk", "ids", "n_bytes", "offsets", "data"])
        for x in (ids, texts, sizes):
            x.clear()
        return out

    for batch in batches:
        for piece in chunks(batch.column("text"), PIECE):
            if texts and sum(map(len, texts)) + len(piece.data) > CHUNK:
                yield row()
            ids.extend(batch.column("doc_id").slice(piece.first, piece.n).to_pylist())
            texts.append(piece.data.tobytes())
            sizes.append(np.diff(piece.offsets))
    if texts:
        yield row()


class Runs:
    """The runs of a chunk row: hash, document (its place in the chunk), first byte, and number of strings."""

    def __init__(self, data: bytes, offsets: bytes):
        self.data, self.offsets = unpacked(data), unpacked(offsets, "<i8")
        at, found = 0, []
        while at < len(self.offsets) - 1:  # whole documents, about PIECE bytes at a time
            end = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + PIECE, "right")) - 1)
            here = self.offsets[at : end + 1]
            least, first, count = self._of(self.data[here[0] : here[-1]], here - here[0])
            found.append((least, first + here[0], count))
            at = end
        none = np.zeros(0, np.int64)
        self.hash, self.first, self.count = (np.concatenate([x.astype(k), *y]) for x, k, y in zip((none,) * 3, (np.uint64, np.int64, np.int64), zip(*found, strict=True) if found else ((),) * 3, strict=True))
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1

    @staticmethod
    def _of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash, first byte and number of strings of each run of a piece."""
        n = len(data)
        if n < WIDTH:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2
        loads = np.ndarray((n - 7,), "<u8", data, strides=(1,))
        least = joined(loads[: n - GRAM + 1], loads[8 : n - GRAM + 9])
        width, need = 1, WIDTH - GRAM + 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if need > width:
            least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
        inside = np.ones(n + 1, bool)
        for back in range(1, WIDTH):  # strings that would cross a document's end
            at = offsets[1:] - back
            inside[at[at >= 0]] = False
        inside = inside[: len(least)]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        starts = offsets[:-1][offsets[:-1] < len(least)]
        begin[starts] = inside[starts]
        first = np.flatnonzero(begin)
        end = inside.copy()
        end[:-1] &= ~inside[1:] | begin[1:]
        return least[first], first, np.flatnonzero(end) + 1 - first

    def part(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The part each hash is dealt to, and four bytes that tell it apart there."""
        h = mix(self.hash)
        return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), h.astype(np.uint32)


def _numbers(ids: list[int | None]) -> np.ndarray:
    return np.array([_LATER if i is None else i for i in ids], np.int64)


def _offer(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk and part: the hashes, how many runs have each, and whether two documents of the chunk have it."""
    for batch in batches:
        for r in batch.to_pylist():
            runs, ids = Runs(r["data"], r["offsets"]), _numbers(r["ids"])
            own = ids[runs.doc] != _LATER
            part, key = (x[own] for x in runs.part(parts))
            doc = ids[runs.doc[own]]
            order = np.lexsort((doc, key, part))
            part, key, doc = part[order], key[order], doc[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(fresh)
            if not len(at):
                continue
            last = np.append(at[1:], len(key)) - 1
            several = doc[at] != doc[last]
            part, key = part[at], key[at]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            times = (last + 1 - at).astype("<u4")
            out = [(int(part[a]), r["fan"], r["chunk"], key[a:b].tobytes(), times[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for a, b in zip(cut, [*cut[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*(pa.int64(),) * 3, *(pa.binary(),) * 3), strict=True)], names=["part", "fan", "chunk", "keys", "times", "several"])


def _lists(group: pa.Table, column: str, kind: str | type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in group.column(column).to_pylist()]


def _several(group: pa.Table, own: list[np.ndarray]) -> list[np.ndarray]:
    return [np.unpackbits(x, count=len(k)).astype(bool) for x, k in zip(_lists(group, "several", np.uint8), own, strict=True)]


def _added(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a part's rows, each once, how many runs have each, and whether several documents do."""
    own = _lists(group, "keys", np.uint32)
    keys, back = np.unique(np.concatenate(own), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, back, np.concatenate(_lists(group, "times", "<u4")))
    several = np.bincount(back, minlength=len(keys)) > 1
    several[back[np.concatenate(_several(group, own))]] = True
    return keys, times, several


def _combined(group: pa.Table) -> pa.Table:
    """What FAN chunks offer to a part, as one row."""
    keys, times, several = _added(group)
    return pa.table({"part": group.column("part")[:1], "fan": group.column("fan")[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "times": pa.array([np.minimum(times, 2**32 - 1).astype("<u4").tobytes()], pa.binary()), "several": pa.array([np.packbits(several).tobytes()], pa.binary())})


def _shared(group: pa.Table, share: int) -> pa.Table:
    """The hashes of a part that several documents have, and how many shares each makes, for every FAN chunks that have offered some."""
    keys, times, several = _added(group)
    shared, shares = keys[several].tobytes(), (1 + times[several] // share).astype("<u4").tobytes()
    n = group.num_rows
    return pa.table({"part": group.column("part"), "fan": group.column("fan"), "keys": pa.array([shared] * n, pa.binary()), "shares": pa.array([shares] * n, pa.binary())})


def _returned(offers: pa.Table, found: pa.Table) -> pa.Table:
    """Of each chunk: its shared hashes of a part, and their shares."""
    keys, shares = np.concatenate([np.zeros(0, np.uint32), *_lists(found, "keys", np.uint32)]), np.concatenate([np.zeros(0, "<u4"), *_lists(found, "shares", "<u4")])
    here = []
    for own in _lists(offers, "keys", np.uint32):
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        some = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        here.append((own[some].tobytes(), shares[at[some]].tobytes() if len(keys) else b""))
    out = pa.table({"chunk": offers.column("chunk"), "part": offers.column("part"), "keys": pa.array([x for x, _ in here], pa.binary()), "shares": pa.array([x for _, x in here], pa.binary()), "split": pa.array([bool((np.frombuffer(x, "<u4") > 1).any()) for _, x in here], pa.bool_())})
    return out.filter(pa.array([len(x) > 0 for x, _ in here], pa.bool_()))


def _spread(runs: Runs, picked: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the picked runs, one run after the other."""
    size = runs.count[picked] + WIDTH - 1
    return np.repeat(runs.first[picked] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _codes(shared: list[dict], split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parts and keys as one number each, sorted, and their shares: those of hashes that are split, or of the others."""
    codes = np.concatenate([np.zeros(0, np.uint64), *((np.uint64(x["part"]) << np.uint64(32)) | np.frombuffer(x["keys"], np.uint32) for x in shared)])
    shares = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x["shares"], "<u4") for x in shared)]).astype(np.int64)
    codes, shares = codes[(shares > 1) == split], shares[(shares > 1) == split]
    order = np.argsort(codes)
    return codes[order], shares[order]


def _picked(runs: Runs, ids: np.ndarray, parts: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of documents with an id whose hashes are among the codes, the places of these codes, and all runs' parts and keys."""
    part, key = runs.part(parts)
    code = (part.astype(np.uint64) << np.uint64(32)) | key
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    picked = np.flatnonzero((codes[at] == code) & (ids[runs.doc] != _LATER))
    return picked, at[picked], part, key


def _heads(rank: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by rank and what follows it, and where in it each rank begins."""
    order = np.lexsort((*reversed(then), rank))
    return order, np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0])) if len(order) else np.zeros(0, np.int64)


_STRINGS = "code long, share long, fan long, chunk long, text binary, least binary, greatest binary, cuts binary, at binary, docs binary"


def _strings(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk, hash that is split, and share: the different strings of its runs, the least and greatest documents that have each here, and all their places and documents."""
    for batch in batches:
        for r in batch.to_pylist():
            codes, shares = _codes(r["shared"], True)
            if not len(codes):
                continue
            runs, ids = Runs(r["data"], r["offsets"]), _numbers(r["ids"])
            picked, of, _, _ = _picked(runs, ids, parts, codes)
            if not len(picked):
                continue
            total = np.cumsum(runs.count[picked])
            for few in np.split(np.arange(len(picked)), np.flatnonzero(np.diff(total // STRINGS)) + 1):
                yield _strings_of(r, runs, ids, picked[few], of[few], codes, shares)


def _strings_of(r: dict, runs: Runs, ids: np.ndarray, picked: np.ndarray, of: np.ndarray, codes: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
    """The rows of _strings for some runs of a chunk."""
    size = runs.count[picked]
    at = np.repeat(runs.first[picked] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    doc, of = np.repeat(ids[runs.doc[picked]], size), np.repeat(of, size)
    order, first = _heads(ranks(runs.data, at, np.full(len(at), WIDTH)), doc)
    at, doc, of = at[order], doc[order], of[order]
    cut = np.append(first, len(at))
    loads, h = np.ndarray((len(runs.data) - 7,), "<u8", runs.data, strides=(1,)), np.zeros(len(first), np.uint64)
    for k in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        h = joined(h, loads[at[first] + k])
    share = (h % shares[of[first]].astype(np.uint64)).astype(np.int64)
    group, starts = _heads(of[first] * (int(shares.max()) + 1) + share)
    rows = []
    for g in np.split(group, starts[1:]):
        where = np.concatenate([np.arange(cut[k], cut[k + 1]) for k in g])
        text = runs.data[at[first[g]][:, None] + np.arange(WIDTH)]
        rows.append((int(codes[of[first[g[0]]]].view(np.int64)), int(share[g[0]]), r["fan"], r["chunk"], text.tobytes(), doc[first[g]].tobytes(), doc[cut[g + 1] - 1].tobytes(), (cut[g + 1] - cut[g]).astype("<i4").tobytes(), at[where].astype("<i4").tobytes(), doc[where].tobytes()))
    kinds = (*(pa.int64(),) * 4, *(pa.binary(),) * 6)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _STRINGS.split(", ")])


def _different(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different strings of all rows of a group, their least and greatest documents, to which of them each row's strings belong, and how many strings each row has."""
    text = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
    least, greatest = (np.concatenate(_lists(group, c, "<i8")) for c in ("least", "greatest"))
    n = len(least)
    rank = ranks(text, np.arange(n) * WIDTH, np.full(n, WIDTH))
    order, first = _heads(rank)
    which = np.empty(n, np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    return text.reshape(n, WIDTH)[order[first]], np.minimum.reduceat(least[order], first), np.maximum.reduceat(greatest[order], first), which, np.array([len(x) // 8 for x in group.column("least").to_pylist()])


def _reduced(group: pa.Table) -> pa.Table:
    """The different strings of a share that FAN chunks have, as one row."""
    text, least, greatest, _, _ = _different(group)
    return pa.table({**{c: group.column(c)[:1] for c in ("code", "share", "fan")}, "text": pa.array([text.tobytes()], pa.binary()), "least": pa.array([least.tobytes()], pa.binary()), "greatest": pa.array([greatest.tobytes()], pa.binary())})


def _earliest(group: pa.Table) -> pa.Table:
    """Of each row's strings the least document of all that have it; beyond any if they are all one."""
    _, least, greatest, which, sizes = _different(group)
    first = np.where(least < greatest, least, _LATER)[which]
    return pa.table({**{c: group.column(c) for c in ("code", "share", "fan")}, "first": pa.array([x.tobytes() for x in np.split(first, np.cumsum(sizes)[:-1])], pa.binary())})


def _located(strings: pa.Table, found: pa.Table) -> pa.Table:
    """Of each chunk: the places of a share's strings that several documents have, these documents, and the least of all."""
    _, _, _, which, sizes = _different(strings)
    first = np.split(np.frombuffer(found.column("first")[0].as_py(), "<i8")[which], np.cumsum(sizes)[:-1])
    rows = []
    for k, least in enumerate(first):
        cuts, at, docs = (np.frombuffer(strings.column(c)[k].as_py(), kind) for c, kind in (("cuts", "<i4"), ("at", "<i4"), ("docs", "<i8")))
        least = np.repeat(least, cuts)
        gone = docs > least
        rows.append((at[gone].tobytes(), int(gone.sum())))
    return pa.table({"chunk": strings.column("chunk"), "at": pa.array([x for x, _ in rows], pa.binary())}).filter(pa.array([n > 0 for _, n in rows], pa.bool_()))


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk and part: its shared runs (key, number, document, strings, text), each text once for its least document, and the numbers of the others."""
    for batch in batches:
        for r in batch.to_pylist():
            codes, _ = _codes(r["shared"], False)
            if not len(codes):
                continue
            runs, ids = Runs(r["data"], r["offsets"]), _numbers(r["ids"])
            picked, _, part, key = _picked(runs, ids, parts, codes)
            part = part[picked]
            doc, size = ids[runs.doc[picked]], runs.count[picked] + WIDTH - 1
            rank = ranks(runs.data, runs.first[picked], size)
            order = np.lexsort((doc, rank))
            first = np.concatenate([[True], np.diff(rank[order]) != 0])
            least = np.empty(len(picked), np.int64)
            least[order] = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = doc > least
            split = [x[np.argsort(part[x], kind="stable")] for x in (np.flatnonzero(~later), np.flatnonzero(later))]
            here = np.unique(part)
            cuts = [(np.searchsorted(part[x], here), np.searchsorted(part[x], here, "right")) for x in split]
            rows, held = [], 0
            for j, p in enumerate(here.tolist()):
                kept, local = (x[a[j] : b[j]] for x, (a, b) in zip(split, cuts, strict=True))
                k = picked[kept]
                rows.append((p, r["chunk"], key[k].tobytes(), packed(np.diff(k, prepend=0).astype("<u4")), packed(doc[kept]), packed(runs.count[k].astype("<u4")), packed(runs.data[_spread(runs, k)]), packed(np.diff(picked[local], prepend=0).astype("<u4"))))
                held += sum(map(len, rows[-1][2:]))
                if held > BATCH or j == len(here) - 1:
                    kinds = (pa.int64(), pa.int64(), *(pa.binary(),) * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "chunk", "keys", "runs", "docs", "counts", "data", "local"])
                    rows, held = [], 0


def _decide(group: pa.Table) -> pa.Table:
    """Of each chunk: the strings of its runs that an earlier document has, as (run, first string, string after the last)."""
    column = lambda c, kind: [unpacked(x, kind) for x in group.column(c).to_pylist()]
    runs, local = ([np.cumsum(x, dtype=np.int64) for x in column(c, "<u4")] for c in ("runs", "local"))
    row = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
    run, doc = np.concatenate(runs), np.concatenate(column("docs", np.int64))
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()])
    count, data = np.concatenate(column("counts", "<u4")).astype(np.int64), np.concatenate(column("data", np.uint8))
    size = count + WIDTH - 1
    begin = np.cumsum(size) - size
    n = len(run)
    found: list[np.ndarray] = [np.zeros((0, 4), np.int64)]  # row, run, first, end
    if n:
        rank = ranks(data, begin, size)
        order = np.lexsort((doc, rank))
        head = np.concatenate([[True], np.diff(rank[order]) != 0])
        leader = np.empty(n, np.int64)  # of equal runs, one of the least document
        leader[order] = order[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
        whole = doc > doc[leader]
        found.append(np.column_stack([row[whole], run[whole], np.zeros(whole.sum(), np.int64), count[whole]]))
        leaders = order[head]
        leaders = leaders[np.argsort(keys[leaders], kind="stable")]
        h = keys[leaders]
        apart = np.zeros(len(h), bool)  # hashes of several different runs
        same = h[1:] == h[:-1]
        apart[1:] |= same
        apart[:-1] |= same
        picked = leaders[apart]
        if len(picked):
            of = np.repeat(np.arange(len(picked)), count[picked])
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count[picked]) - count[picked], count[picked])
            rank = ranks(data, begin[picked[of]] + nth, np.full(len(of), WIDTH))
            least = np.full(len(of), _LATER)
            np.minimum.at(least, rank, doc[picked[of]])
            hit = doc[picked[of]] > least[rank]
            inner = hit[1:] & hit[:-1] & (nth[1:] > 0)  # goes on what the string before began
            begins, ends = np.flatnonzero(hit & ~np.append(False, inner)), np.flatnonzero(hit & ~np.append(inner, False)) + 1
            if len(begins):
                which, a, b = of[begins], nth[begins], nth[ends - 1] + 1
                # what holds for a leader holds for equal runs of the same document too
                equal = order[~whole[order]]
                group_of = np.empty(n, np.int64)
                group_of[picked] = np.arange(len(picked))
                member = equal[np.isin(leader[equal], picked)]
                member = member[np.argsort(group_of[leader[member]], kind="stable")]
                number = group_of[leader[member]]
                lo, hi = np.searchsorted(number, which), np.searchsorted(number, which, "right")
                times = hi - lo
                to = member[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                found.append(np.column_stack([row[to], run[to], np.repeat(a, times), np.repeat(b, times)]))
    out = np.concatenate(found)
    out = out[np.argsort(out[:, 0], kind="stable")]
    cut = np.searchsorted(out[:, 0], np.arange(len(runs) + 1))
    spans = [packed(out[cut[k] : cut[k + 1], 1:].astype("<i4")) for k in range(len(runs))]
    some = pa.array([bool(cut[k + 1] > cut[k] or len(local[k])) for k in range(len(runs))], pa.bool_())
    return pa.table({"chunk": group.column("chunk"), "spans": pa.array(spans, pa.binary()), "local": group.column("local")}).filter(some)


def _removed(runs: Runs, found: list[dict] | None, split: list[bytes] | None) -> np.ndarray:
    """Flags of the bytes of a chunk that go: those of the dealt runs' strings, and of the strings of split hashes, that an earlier document has."""
    step = np.zeros(len(runs.data) + 1, np.int32)
    if split:
        at = np.frombuffer(b"".join(split), "<i4").astype(np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + WIDTH, -1)
    if found:
        local = np.concatenate([np.cumsum(unpacked(x["local"], "<u4"), dtype=np.int64) for x in found])
        spans = np.concatenate([unpacked(x["spans"], "<i4") for x in found]).reshape(-1, 3).astype(np.int64)
        for begin, end in ((runs.first[local], runs.first[local] + runs.count[local]), (runs.first[spans[:, 0]] + spans[:, 1], runs.first[spans[:, 0]] + spans[:, 2])):
            np.add.at(step, begin, 1)
            np.add.at(step, end - 1 + WIDTH, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            runs = Runs(r["data"], r["offsets"])
            gone, offsets, data = _removed(runs, r["found"], r["split"]), runs.offsets, runs.data
            out, held = [], 0
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = gone[a:b]
                spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if b > a else 0
                kept = data[a:b][~own] if spans else data[a:b]
                out.append((r["ids"][i], b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.tobytes()))
                held += len(kept)
                if held > BATCH or i == len(offsets) - 2:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    out, held = [], 0


def without_repeated_spans(documents: DataFrame, share: int = SHARE, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept, the bytes that stay.

    A byte goes if a string of WIDTH bytes that covers it starts in a document of smaller doc_id too, in the texts as given. documents: doc_id (a whole number) and text; other columns are ignored. A null text is empty; texts of fewer than WIDTH bytes stay whole; rows of equal doc_id don't count as earlier than each other; a row without doc_id stays whole and takes nothing from others; an empty table gives an empty result.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(docs.mapInArrow(_chunk_rows, "chunk long, ids array<long>, n_bytes long, offsets binary, data binary"))
    total, n_chunks = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    parts = max(12, -(-total // PART))
    table = table.withColumn("fan", F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-n_chunks // fan)))))
    offers = table.select("chunk", "fan", "ids", "offsets", "data").mapInArrow(lambda b: _offer(b, parts), "part long, fan long, chunk long, keys binary, times binary, several binary")
    of_some = offers.groupBy("part", "fan")
    combined = of_some.applyInArrow(_combined, "part long, fan long, keys binary, times binary, several binary")
    judged = combined.groupBy("part").applyInArrow(lambda group: _shared(group, share), "part long, fan long, keys binary, shares binary")
    every = written(of_some.cogroup(judged.groupBy("part", "fan")).applyInArrow(_returned, "chunk long, part long, keys binary, shares binary, split boolean"))
    shared = every.groupBy("chunk").agg(F.collect_list(F.struct("part", "keys", "shares")).alias("shared"))  # of one chunk's bounded size
    dealt = table.join(shared, "chunk").mapInArrow(lambda b: _deal(b, parts), "part long, chunk long, keys binary, runs binary, docs binary, counts binary, data binary, local binary")
    found = dealt.groupBy("part").applyInArrow(_decide, "chunk long, spans binary, local binary")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("spans", "local")).alias("found"))
    splits = written(every.where("split").groupBy("chunk").agg(F.collect_list(F.struct("part", "keys", "shares")).alias("shared")))
    strings = written(table.join(splits, "chunk").mapInArrow(lambda b: _strings(b, parts), _STRINGS))
    of_share = strings.groupBy("code", "share", "fan")
    reduced = of_share.applyInArrow(_reduced, "code long, share long, fan long, text binary, least binary, greatest binary")
    earliest = reduced.groupBy("code", "share").applyInArrow(_earliest, "code long, share long, fan long, first binary")
    located = of_share.cogroup(earliest.groupBy("code", "share", "fan")).applyInArrow(_located, "chunk long, at binary")
    split = located.groupBy("chunk").agg(F.collect_list("at").alias("split"))  # of one chunk's bounded size
    both = table.join(found, "chunk", "left").join(split, "chunk", "left")
    return both.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
