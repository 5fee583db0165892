import math
import re
from collections import Counter

from attestra.llm.quality_rules import RULES, quality_rules

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    " ".join(f"word{i} and" for i in range(30)),
    " ".join(["a b c d e f g h i j"] * 4),
    "same line\nsame line\n\nother\nsame line",
    "x# y$ z% " * 12,
    "é è ü ñ " * 9 + "\x0b\x0c tail",
    "w" * 50_000,
    "long " * 20_000,
]


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    at = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n, r = len(words), len(at)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_base_columns_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (4, TEXTS[4], "again")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, votes string")).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_votes_tell_junk_from_prose(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    got = quality_rules(docs).where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [not r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.8


def plain_em(votes):
    """Each document's posterior by expectation-maximisation, document by document."""
    n, prior = len(votes), {0: (0.1, 0.4, 0.5), 1: (0.1, 0.01, 0.89)}
    good = [0.1 if 1 in v else 0.95 for v in votes]
    for _ in range(200):
        table = {}
        for c in (0, 1):
            for j in range(len(RULES)):
                mass = [prior[c][x] * 0.01 * n for x in range(3)]
                for v, g in zip(votes, good, strict=True):
                    mass[v[j]] += g if c else 1 - g
                table[c, j] = [m / sum(mass) for m in mass]
        share = (sum(good) + 0.5) / (n + 1)
        new = []
        for v in votes:
            a, b = (math.log(p) + sum(math.log(table[c, j][x]) for j, x in enumerate(v)) for c, p in ((0, 1 - share), (1, share)))
            new.append(1 / (1 + math.exp(min(a - b, 500))))
        if max(abs(x - y) for x, y in zip(good, new, strict=True)) < 1e-9:
            break
        good = new
    return new


def test_posteriors_match_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality_rules(docs).collect()
    want = plain_em([r.votes for r in got])
    assert max(abs(r.p_good - p) for r, p in zip(got, want, strict=True)) < 1e-6
    assert all(r.kept == (not r.base_failed and p >= 0.5) for r, p in zip(got, want, strict=True) if abs(p - 0.5) > 1e-6)


def test_a_rule_worse_than_chance_is_turned_around(spark):
    """A rule that calls what the others hold good bad, and the reverse, ends up speaking for them."""
    import numpy as np

    from attestra.llm.quality_rules import learn_rules, posterior

    rnd = np.random.default_rng(3)
    truth = rnd.random(4000) < 0.7
    right = rnd.random((4000, 6)) < 0.9
    votes = np.where(right == truth[:, None], 2, 1)
    votes[:, 5] = np.where((rnd.random(4000) < 0.85) == truth, 1, 2)  # the contrary of the truth, mostly
    share, table = learn_rules(votes, np.ones(4000))
    assert table[1, 5, 1] > table[1, 5, 2] and table[0, 5, 2] > table[0, 5, 1]
    assert ((posterior(votes, share, table) >= 0.5) == truth).mean() > 0.97
