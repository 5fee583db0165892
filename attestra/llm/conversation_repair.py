"""Conversations brought into the form `(system? (user assistant)+)?` by cheapest edits.

A conversation's rows are layers of a graph with four nodes each: nothing yet (START), after a system row (SYSTEM), after a user row (USER), after an assistant row (REPLY). Edits are its arcs and cost 0 to 6, so that Dial's ring of buckets finds all distances to the end without a heap; a walk from the start along tight arcs (those that lie on a cheapest path), the least letter first, gives the audit.

Rows are pre-aggregated where equal, dealt by ranges of (conv_id, turn, role, text) and packed into blocks of bounded size, so that a conversation of any length is spread over tasks. Conversations that lie within one block, nearly all, are repaired where they are. Of the others each block becomes a matrix of costs from node to node; one fold backwards over these small matrices gives each block its distances to the end; then one pass in order, in bounded memory, walks and hashes, as a SHA-256 of a whole conversation needs its text in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StringType, StructType

from attestra.llm.shared_tables import bounded_batches, written

START, SYSTEM, USER, REPLY = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The node that a new or renamed row leads to, and the role that it gets.
_NEXT = (USER, USER, REPLY, USER)
_ROLE = ("user", "user", "assistant", "user")
#: The node that a kept row leads to, by its role's initial.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": REPLY}, {"u": USER})
_BEFORE = tuple(tuple(s for s in range(4) if _NEXT[s] == t) for t in range(4))
_KEPT_BEFORE = tuple(tuple((s, c) for s in range(4) for c, to in _KEPT[s].items() if to == t) for t in range(4))
FAR = 1 << 30
#: More than the costliest arc and than the spread of distances at one layer.
RING = 32
#: Distances at the end of a conversation, before insertions.
END = (0, FAR, FAR, 0)
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20

_SAID = re.compile(r"[^\x20\x09-\x0D]")
_FINISHED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_LEGAL = {"su", "ua", "au"}
OK, BLANK, DUPLICATE, CUT_SHORT = range(4)
_INTS, _LONGS, _STRINGS = (ArrayType(x()) for x in (IntegerType, LongType, StringType))


def distances(initials: list[str], cut_short: list[bool], end: tuple[int, ...] | list[int] = END) -> list[int]:
    """Of node s at layer i, at 4 * i + s, the cost to the end; end: what the nodes after the last row still cost."""
    m = len(initials)
    dist, ring, left = [FAR] * (4 * m + 4), [[] for _ in range(RING)], 0

    def reach(v: int, d: int) -> None:
        nonlocal left
        if d < dist[v]:
            dist[v] = d
            ring[d % RING].append(v)
            left += 1

    for t, d in enumerate(end):
        if d < FAR:
            reach(4 * m + t, d)
    d = min(end)
    while left:
        bucket = ring[d % RING]
        while bucket:
            v = bucket.pop()
            left -= 1
            if dist[v] != d:  # reached at less cost since
                continue
            i, t = divmod(v, 4)
            for s in _BEFORE[t]:
                reach(4 * i + s, d + INSERT)
            if i:
                extra = TRUNCATED if cut_short[i - 1] else 0
                reach(v - 4, d + DELETE)
                for s in _BEFORE[t]:
                    reach(4 * i - 4 + s, d + REROLE + extra)
                for s, c in _KEPT_BEFORE[t]:
                    if c == initials[i - 1]:
                        reach(4 * i - 4 + s, d + KEEP + extra)
        d += 1
    return dist


class Rows:
    """A block's rows: role, text, how many equal ones in a row, and the first one's fault. Blank and duplicate rows are sure to be deleted and no part of the graph."""

    def __init__(self, roles: list[str], texts: list[str] | None, copies: list[int], faults: list[int]):
        self.roles, self.texts, self.copies, self.faults = roles, texts, copies, faults
        self.free = [k for k, f in enumerate(faults) if f in (OK, CUT_SHORT)]
        self.initials = [roles[k][:1] for k in self.free]
        self.cut_short = [faults[k] == CUT_SHORT for k in self.free]

    def matrix(self) -> list[int]:
        """The cost from each node before the block to each node after it, row by row."""
        to = [distances(self.initials, self.cut_short, [0 if s == t else FAR for s in range(4)])[:4] for t in range(4)]
        return [to[t][s] for s in range(4) for t in range(4)]

    def edits(self, state: int, end: list[int] | tuple[int, ...], last: bool) -> tuple[list[tuple[str, int, int, str | None, str | None]], int]:
        """The cheapest edits from a node on, the ASCII-least of them, as (letter, how often, cost, role, text), and the node after them."""
        dist, m, out = distances(self.initials, self.cut_short, end), len(self.free), []
        deleted = lambda n: out.append(("D", n, DELETE * n, None, None)) if n else None
        at = 0
        for i in range(m + 1):
            until = self.free[i] if i < m else len(self.roles)
            deleted(sum(self.copies[at:until]))
            at = until + 1
            while True:
                here, then = dist[4 * i + state], _NEXT[state]
                inserts = dist[4 * i + then] + INSERT == here
                if i == m:
                    if last and here and inserts:
                        out.append(("I", 1, INSERT, _ROLE[state], ""))
                        state = then
                        continue
                    break
                extra, initial = TRUNCATED if self.cut_short[i] else 0, self.initials[i]
                k, keeps = self.free[i], _KEPT[state].get(initial)
                if dist[4 * i + 4 + state] + DELETE == here:
                    deleted(1)
                elif inserts:
                    out.append(("I", 1, INSERT, _ROLE[state], ""))
                    state = then
                    continue
                elif keeps is not None and dist[4 * i + 4 + keeps] + KEEP + extra == here:
                    out.append(("K", 1, KEEP + extra, self.roles[k], self.texts[k]))
                    state = keeps
                else:
                    out.append(("R", 1, REROLE + extra, _ROLE[state], self.texts[k]))
                    state = then
                deleted(self.copies[k] - 1)
                break
        return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conv_id, turn, role and text (nulls of the last two: one space) with faults put in by the crc32 of `conv_id:turn` modulo 20, and copies: how many rows each stands for. A dropped row leaves one without turn, role, text and copies, so that its conversation is not lost."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    kept = lambda c: F.when(kind != 0, c)
    return conversations.select(
        "conv_id", kept(F.col("turn")).cast("long").alias("turn"), kept(F.when(kind == 4, "user").otherwise(said("role"))).alias("role"), kept(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def as_rows(conversations: DataFrame) -> DataFrame:
    """conversations as they are, in the form of damaged()."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"), F.lit(1).cast("long").alias("copies"))


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows in order, packed: conv_id, block (grows along a conversation), alone (surely the conversation's only one), turns, roles, texts, copies, faults (of the first copy, as far as the block shows) and keys (digests of role and text; null if alone)."""
    keys = ["conv_id", "turn", "role", "text"]
    grouped = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    begins = F.substring("text", 1, 64)  # a bound on what the ranges' samples hold
    ordered = grouped.repartitionByRange("conv_id", "turn", "role", begins).sortWithinPartitions(*keys)
    schema = ordered.select("conv_id").schema.add("block", "long").add("alone", "boolean").add("turns", _LONGS).add("roles", _STRINGS).add("texts", _STRINGS).add("copies", _LONGS).add("faults", _INTS).add("keys", ArrayType(BinaryType()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks, conv_type = TaskContext.get(), 0, None
        first = (task.partitionId() if task else 0) << 32
        conv, held, size, seen, n_before, inner = None, None, 0, set(), 0, False

        def closed(alone: bool) -> tuple:
            nonlocal n_blocks
            n_blocks += 1
            digest = None if alone else [hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(held[1], held[2], strict=True)]
            return (conv, first + n_blocks, alone, *held, digest)

        def flushed(done: list[tuple]) -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], names=["conv_id", "block", "alone", "turns", "roles", "texts", "copies", "faults", "keys"])

        for batch in batches:
            done, conv_type = [], batch.schema.field("conv_id").type
            for c, turn, role, text, n in zip(*(batch.column(x).to_pylist() for x in (*keys, "copies")), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        done.append(closed(alone=inner and n_before == 0))
                    inner, conv, held, size, seen, n_before = held is not None, c, ([], [], [], [], []), 0, set(), 0
                elif len(held[0]) >= block_rows or size >= BLOCK_CHARS:
                    done.append(closed(alone=False))
                    held, size, seen, n_before = ([], [], [], [], []), 0, set(), n_before + 1
                if not n:
                    continue
                fault = BLANK if not _SAID.search(text) else DUPLICATE if (role, text) in seen else OK if _FINISHED.search(text) else CUT_SHORT
                seen.add((role, text))
                size += len(text)
                for column, v in zip(held, (turn, role, text, n, fault), strict=True):
                    column.append(v)
            if done:
                yield flushed(done)
        if held is not None:
            yield flushed([closed(alone=False)])

    return ordered.mapInArrow(pack, schema)


def _with_duplicates(parts: DataFrame) -> DataFrame:
    """Blocks and repeats: places of rows whose role and text an earlier block of the conversation has."""
    each = parts.select("conv_id", "block", F.posexplode("keys").alias("place", "key"))
    several = each.groupBy("conv_id", "key").agg(F.min("block").alias("first"), F.max("block").alias("most")).where("first < most").select(F.col("conv_id").alias("conv__"), F.col("key").alias("key__"), "first")
    later = each.join(several, F.col("conv_id").eqNullSafe(F.col("conv__")) & (F.col("key") == F.col("key__"))).where("block > first")
    places = later.groupBy(F.col("block").alias("block__")).agg(F.collect_list("place").alias("repeats"))
    return parts.join(places, F.col("block") == F.col("block__"), "left").drop("block__")


def _faults(faults: list[int], repeats: list[int] | None) -> list[int]:
    for k in repeats or ():
        if faults[k] != BLANK:
            faults[k] = DUPLICATE
    return faults


def _distances_to_end(parts: DataFrame) -> DataFrame:
    """Of each block: togo, what the nodes after it still cost (less what they all cost), and last."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Rows(roles, None, copies, _faults(faults, repeats)).matrix() for roles, copies, faults, repeats in zip(*(batch.column(c).to_pylist() for c in ("roles", "copies", "faults", "repeats")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(made, pa.list_(pa.int32()))], names=["conv_id", "block", "matrix"])

    keys = parts.select("conv_id", "block").schema
    found = parts.select("conv_id", "block", "roles", "copies", "faults", "repeats").mapInArrow(matrices, keys.add("matrix", _INTS))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, togo, begun = None, END, False
        for batch in batches:
            out, ends = [], []
            for c, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                last = not begun or c != conv
                if last:
                    conv, togo, begun = c, list(END), True
                out.append(togo)
                ends.append(last)
                before = [min(matrix[4 * s + t] + togo[t] for t in range(4)) for s in range(4)]
                least = min(before)
                togo = [min(FAR, x - least) for x in before]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.list_(pa.int32())), pa.array(ends)], names=["block__", "togo", "last"])

    backwards = found.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return backwards.mapInArrow(fold, "block__ long, togo array<int>, last boolean")


_FIELDS = ("roles", "texts", "copies", "faults", "repeats", "togo", "last")


def _edited(batch: pa.RecordBatch, state: dict) -> Iterator[tuple]:
    """(conv_id, whether the conversation begins here, turns, rows, edits) of each block of a batch; state carries the node from block to block."""
    for conv, turns, *given in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", *_FIELDS)), strict=True):
        roles, texts, copies, faults, repeats, togo, last = given
        begins = not state or state["last"]
        rows = Rows(roles, texts, copies, _faults(faults, repeats))
        edits, node = rows.edits(START if begins else state["node"], togo, last)
        state.update(node=node, last=last)
        yield conv, begins, turns, rows, edits


def _in_order(rows: DataFrame, block_rows: int) -> list[DataFrame]:
    """Blocks with what their repair needs, those of a conversation in order in one partition: first those that are alone, then the others."""
    bounded_batches(rows.sparkSession)
    blocks = written(_blocks(rows, block_rows))
    alone = blocks.where("alone").select("conv_id", "block", "turns", *(x if x in blocks.columns else F.lit(None).cast("array<int>").alias(x) for x in _FIELDS[:5]), F.array(*map(F.lit, END)).alias("togo"), F.lit(True).alias("last"))
    parts = written(_with_duplicates(blocks.where("NOT alone").drop("alone")))
    ends = _distances_to_end(parts)
    joined = parts.join(ends, F.col("block") == F.col("block__")).select("conv_id", "block", "turns", *_FIELDS)
    return [alone, joined.repartition("conv_id").sortWithinPartitions("conv_id", "block")]


_DIGEST = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, held, conv_type = {}, None, None

    def closed() -> tuple:
        gaps = 0 if held["least"] is None else held["most"] - held["least"] + 1 - held["turns"]
        return (held["conv"], gaps, *(held[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(held["audit"]), held["hash"].hexdigest())

    def flushed(done: list[tuple]) -> pa.RecordBatch:
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], names=["conv_id", *_DIGEST])

    for batch in batches:
        done, conv_type = [], batch.schema.field("conv_id").type
        for conv, begins, turns, rows, edits in _edited(batch, state):
            if begins:
                if held is not None:
                    done.append(closed())
                held = {"conv": conv, "least": None, "most": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "empty": True, "initial": None}
            known = [t for t in turns if t is not None]
            if known:
                held["turns"] += (known[0] != held["most"]) + sum(a != b for a, b in pairwise(known))
                held["least"], held["most"] = known[0] if held["least"] is None else held["least"], known[-1]
            for role, n, fault in zip(rows.roles, rows.copies, rows.faults, strict=True):
                held["illegal"] += (held["initial"] is not None and held["initial"] + role[:1] not in _LEGAL) + n - 1
                held["initial"] = role[:1]
                held["blank"] += n if fault == BLANK else 0
                held["truncated"] += fault == CUT_SHORT
                held["duplicate"] += n if fault == DUPLICATE else 0 if fault == BLANK else n - 1
            for letter, n, cost, role, text in edits:
                held["audit"].append(letter * n)
                held["cost"] += cost
                if role is not None:
                    held["hash"].update(f"{'' if held['empty'] else '\n'}{role}:{text}".encode())
                    held["empty"] = False
        if done:
            yield flushed(done)
    if held is not None:
        yield flushed([closed()])


def digest(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text and copies, as damaged() and as_rows() give them): gaps in its turns, rows by their first fault (blank, duplicate, truncated), illegal neighbours, the cost of the cheapest edits, their audit, and the SHA-256 of the repaired `role:text`, newline-joined.

    Rows are taken by turn, nulls first, rows of one turn by role and text. A conversation of rows without copies has zeros, an empty audit and the hash of an empty string; rows without conv_id are one conversation. An empty role has no initial and can't be kept. Repeated rows are duplicates. Texts are taken whole. Of a conversation, its audit and one block of rows are held in memory.
    """
    return _both(rows, _digests, rows.select("conv_id").schema, _DIGEST, block_rows)


_REPAIRED = {"block": "long", "edits": _STRINGS, "roles": _STRINGS, "texts": _STRINGS}


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict = {}
    for batch in batches:
        kept = [(conv, [e for e in edits if e[3] is not None]) for conv, _, _, _, edits in _edited(batch, state)]
        columns = [pa.array([c for c, _ in kept], batch.schema.field("conv_id").type), batch.column("block"), *(pa.array([[e[k] for e in edits] for _, edits in kept], pa.list_(pa.string())) for k in (0, 3, 4))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *_REPAIRED])


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired rows themselves: conv_id, block and place (their order), edit (K kept, R renamed, I inserted), role and text; of the same rows as digest()."""
    lists = _both(rows, _repairs, rows.select("conv_id").schema, _REPAIRED, block_rows)
    return lists.select("conv_id", "block", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "row")).select("conv_id", "block", "place", F.col("row.edits").alias("edit"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def _both(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType, more: dict[str, str | DataType], block_rows: int) -> DataFrame:
    for name, kind in more.items():
        schema = schema.add(name, kind)
    alone, others = (x.mapInArrow(work, schema) for x in _in_order(rows, block_rows))
    return alone.unionByName(others)
