import math
from collections import Counter
from fractions import Fraction

import pytest

from attestra.llm.queries import WEIGHTS
from attestra.llm.source_mixing import mixed


def documents(spark, sizes):
    rows, k = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((k, name, "clash"))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, source string, slot string")


def brute(blocks, shares):
    """The schedule slot by slot, with a new period whenever the set of sources changes."""
    out, slot, period = {}, 0, 0
    last = {s: -(-n // shares[s]) for s, n in blocks.items()}
    while any(period < x for x in last.values()):
        here = sorted(s for s in blocks if period < last[s])
        size, done = sum(shares[s] for s in here), Counter()
        for t in range(size):
            ready = [(-(-(done[s] + 1) * size // shares[s]), s) for s in here if done[s] < shares[s] and done[s] * size // shares[s] <= t]
            s = min(ready)[1]
            out[s, period * shares[s] + done[s]] = slot
            done[s] += 1
            slot += 1
        period += 1
    return out


@pytest.mark.parametrize("weights", [{}, {"a": 5.0, "b": 2.5}, {"c": 0.3}])
def test_schedule_matches_brute_force(spark, weights):
    sizes = {"a": 701, "b": 300, "c": 45, None: 20, "d": 1}
    got = mixed(documents(spark, sizes), weights, block=4, resolution=20, digits=1).collect()
    assert len(got) == sum(sizes.values())
    key = lambda s: "-" if s is None else "=" + s
    total = sum(weights.get(s, 1.0) for s in sizes)
    shares = {key(s): max(1, int(weights.get(s, 1.0) / total * 20 + 0.5)) for s in sizes}
    want = brute({key(s): -(-n // 4) for s, n in sizes.items()}, shares)
    assert {(key(r.source), r.block): r.slot for r in got} == {k: v for k, v in want.items() if k in {(key(r.source), r.block) for r in got}}
    full = Counter((r.source, r.block) for r in got)
    assert all(n == 4 or b == (sizes[s] - 1) // 4 for (s, b), n in full.items())
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert len({r.slot for r in got}) == len(full)


def test_less_than_one_block_off(spark):
    sizes = {"a": 900, "b": 400, "c": 250, "d": 170}
    weights = {"a": 0.52, "b": 0.27, "c": 0.13, "d": 0.08}
    got = mixed(documents(spark, sizes), weights, block=1, resolution=100, digits=1).collect()
    order = [r.source for r in sorted(got, key=lambda r: r.slot)]
    seen = Counter()
    for t, s in enumerate(order[:1400], 1):
        seen[s] += 1
        assert all(abs(seen[x] - Fraction(int(w * 100 + 0.5), 100) * t) < 1 for x, w in weights.items()), t


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "a", "x"), (1, "a", "x"), (2, "", "y")], "doc_id long, source string, text string")
    got = mixed(docs).collect()
    assert len(got) == 4 and len({(r.slot, r.place) for r in got}) == 4
    assert mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixed(docs, {"a": 0.0})


def off_by_a_block(rows, weights, sources):
    """The first place at which a source is a block or more off its unrounded weight, if any."""
    exact = {s: Fraction(str(weights.get(s, 1))) for s in sources}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    total, seen = sum(whole.values()), Counter()
    for t, r in enumerate(sorted(rows, key=lambda r: r.slot), 1):
        seen[r.source] += 1
        if any(abs(seen[s] * total - w * t) >= total for s, w in whole.items()):
            return t
    return None


def test_exact_weights_over_many_periods(spark):
    weights = {"src0": 4.0, "src1": 2.5, "src2": 1.5, "src3": 0.5}
    sizes = {f"src{k}": int(2 * weights.get(f"src{k}", 1) * 30) for k in range(20)}  # 30 periods of 49 slots
    got = mixed(documents(spark, sizes), weights, block=1, digits=1).collect()
    assert len(got) == len({r.slot for r in got}) == 1470 and max(r.slot for r in got) == 1469
    assert off_by_a_block(got, weights, sizes) is None
    thirds = {"a": Fraction(1, 3), "b": 0.7}
    sizes = {"a": 10 * 20, "b": 21 * 20, "c": 30 * 20}
    assert off_by_a_block(mixed(documents(spark, sizes), thirds, block=1, digits=1).collect(), {"a": Fraction(1, 3), "b": Fraction(7, 10)}, sizes) is None


def test_exact_weights_of_many_sources(spark):
    weights = {"s0": 4.0, "s1": 2.5}
    sizes = {f"s{k}": int(2 * weights.get(f"s{k}", 1) * 2) for k in range(450)}
    got = mixed(documents(spark, sizes), weights, block=1, digits=1).collect()
    assert len(got) == sum(sizes.values()) and off_by_a_block(got, weights, sizes) is None


def test_too_fine_weights_are_refused(spark):
    with pytest.raises(ValueError):
        mixed(documents(spark, {"a": 1}), {"a": 1 / 3})


def test_production_weights_over_thousands_of_blocks(spark):
    sizes = {f"src{k}": int(2 * WEIGHTS.get(f"src{k}", 1) * 110) for k in range(20)}
    got = mixed(documents(spark, sizes), WEIGHTS, block=1).collect()
    assert len(got) == 5390 and off_by_a_block(got, WEIGHTS, sizes) is None


def test_fine_weights_of_many_sources(spark):
    """A period of over 14,000 slots."""
    weights = {f"s{k}": Fraction(1024 - k, 1024) for k in range(14)}
    docs = documents(spark, {f"s{k}": 3 for k in range(14)})
    got = mixed(docs, weights, block=1, digits=1).collect()
    want = brute({f"=s{k}": 3 for k in range(14)}, {f"=s{k}": 1024 - k for k in range(14)})
    assert len({r.slot for r in got}) == 42
    assert {("=" + r.source, r.block): r.slot for r in got} == {k: v for k, v in want.items() if k[1] < 3}
