import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from attestra.llm import conversation_repair as C

WHITE = " \t\n\v\f\r"


def plain(rows):
    """Counts and the cheapest, ASCII-least edits of one conversation's (turn, role, text), by best-first search over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal]
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, form, kept = heapq.heappop(heap)
        here = form[-1:] if len(form) < 2 or form[-1] != "s" else "x"
        if (i, here) in done:
            continue
        done.add((i, here))
        if i == len(rows) and here in ("", "a"):
            return [*counts, cost, audit, "\n".join(kept)]
        new = "assistant" if here == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, form + new[0], (*kept, new + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, form, kept))
            if faults[i] in ("", "truncated"):
                late = 5 if faults[i] else 0
                heapq.heappush(heap, (cost + 1 + late, audit + "R", i + 1, form + new[0], (*kept, f"{new}:{text}")))
                if role[:1] == new[0] or role[:1] == "s" and not form:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, form + role[0], (*kept, f"{role}:{text}")))


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        found = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        found += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: [*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest()] for conv, found in out.items() for x in [plain(found)]}


def made(rnd, n_conversations, most):
    text = lambda: rnd.choice(["Hi.", "Yes!", "So", "", None, " \t", "Why?\n", "é.", "end", f"t{rnd.randint(0, 99)}."])
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "User"])
    return [(conv, rnd.choice([None, *range(12)]) if rnd.random() < 0.3 else k, role(), text()) for conv in [None, *range(n_conversations)] for k in range(rnd.randint(0, most))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block_rows,parts", [(4096, 4), (2, 3), (1, 5)])
def test_repairs_match_best_first_search(spark, block_rows, parts):
    rows = made(random.Random(block_rows), 60, 9)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = C.digest(C.damaged(spark.createDataFrame(rows, SCHEMA)), block_rows=block_rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.conv_id: list(r)[1:] for r in got} == damage(rows) and len(got) == len({r[0] for r in rows})


def test_one_conversation_holds_all_rows(spark):
    rnd = random.Random(4)
    rows = [(1, k, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", "Well.", f"t{k % 60}."])) for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    (got,) = C.digest(C.damaged(docs), block_rows=16).collect()
    assert list(got)[1:] == damage(rows)[1]


def test_distances_match_relaxation():
    rnd = random.Random(5)
    for _ in range(200):
        m = rnd.randint(0, 7)
        initials, late = [rnd.choice("suat") for _ in range(m)], [rnd.random() < 0.3 for _ in range(m)]
        want = [C.FAR] * (4 * m + 4)
        want[4 * m], want[4 * m + 3] = 0, 0
        for _ in range(3 * m + 6):
            for i in range(m, -1, -1):
                for s in range(4):
                    ways = [want[4 * i + C._NEXT[s]] + 5]
                    if i < m:
                        extra = 5 if late[i] else 0
                        ways += [want[4 * i + 4 + s] + 2, want[4 * i + 4 + C._NEXT[s]] + 1 + extra]
                        if initials[i] in C._KEPT[s]:
                            ways.append(want[4 * i + 4 + C._KEPT[s][initials[i]]] + extra)
                    want[4 * i + s] = min(want[4 * i + s], *ways)
        assert C.distances(initials, late) == want


def test_repaired_rows_have_the_form(spark):
    rows = made(random.Random(6), 40, 8)
    found = C.repaired(C.as_rows(spark.createDataFrame(rows, SCHEMA)), block_rows=3).collect()
    forms = {}
    for r in sorted(found, key=lambda r: (r.block, r.place)):
        forms.setdefault(r.conv_id, []).append(r.role[0])
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    for form in forms.values():
        rest = form[1:] if form[0] == "s" else form
        assert rest and "".join(rest) == "ua" * (len(rest) // 2)


def test_empty_table_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Yes.", 5, "x")], SCHEMA + ", copies int, audit string")
    assert C.digest(C.as_rows(docs.limit(0))).collect() == []
    (got,) = C.digest(C.as_rows(docs.union(docs))).collect()
    assert (got.audit, got.cost, got.duplicate, got.illegal) == ("KDKD", 4, 2, 2)
    (long,) = C.digest(C.as_rows(docs.withColumn("text", F.expr("repeat('long text. ', 200000)")))).collect()
    assert long.audit == "KK" and long.cost == 0
