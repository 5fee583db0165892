import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from attestra.llm.token_counts import BYTE, SPECIAL, UNKNOWN_PENALTY, Counter, token_counts, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return vocabulary(PATH)


def oracle(pieces, texts):
    # byte pieces and special ones stand for no characters, so they get names that no text has
    known = [(p if s and not p.startswith("<0x") else p, s) for p, s in pieces]
    t = Tokenizer(models.Unigram(known, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]


def check(spark, pieces, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, pieces).collect()}
    want = oracle(pieces, texts)
    assert [(t[:60], got[i]) for i, t in enumerate(texts)] == [(t[:60], n) for t, n in zip(texts, want, strict=True)]


def test_random_texts(spark, pieces):
    rnd = random.Random(4)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "▁", "a", "b", "zq", ".", ", ", "123", "mente", "ción", "Th", "\u0000", "x" * 20]
    check(spark, pieces, ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + ["", " ", "\n", "\n\n a", "a ", "z" * 3000, "the " * 5000])


def test_documents(spark, pieces, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, pieces, texts)


def test_ties(spark):
    # every cut of "aaaa" into pieces of two letters or less scores the same
    pieces = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0), ("b", -1.0), ("ab", -2.0)] + [(f"<0x{b:02X}>", -5.0) for b in range(256)]
    check(spark, pieces, ["aaaa", "a aa aaa aaaaa", "abab baab", "aaaabaaab"])


def test_odd_rows(spark, pieces):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "the"), (1, "the")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, pieces).collect()) == [(0, 0), (1, 0), (1, 1), (1, 1)]
    assert token_counts(docs.limit(0), pieces).count() == 0


def test_pieces_of_score_zero(spark):
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", 0.0), ("▁", -1.0), ("c", 0.0)] + [(f"<0x{b:02X}>", -5.0) for b in range(256)]
    check(spark, pieces, ["ab", "abab c", "aabbcc"])


def plain(pieces, text):
    """The contract without automaton, ring or cache: each word by trying all pieces at every end."""
    scores = {p: s for p, s in pieces if p not in SPECIAL and not BYTE.fullmatch(p)}
    unknown = min(s for p, s in pieces if p not in SPECIAL) - UNKNOWN_PENALTY
    if not text:
        return 0
    total = 0
    for k, hard in enumerate(re.split("([\t\n])", text)):
        if hard in ("\t", "\n"):
            total += 1
            continue
        words = hard.replace("▁", " ").split(" ")
        for j, word in enumerate(words):
            if k == 0 and j == 0 and word == "" and len(words) > 1:  # a text that begins with a space gets no sign before it
                continue
            word = "▁" + word if j or k == 0 else word  # noqa: PLW2901
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                top = None
                for begin in range(end):  # the longest last piece first
                    piece = word[begin:end]
                    if piece in scores and (top is None or best[begin][0] + scores[piece] > top[0]):
                        top = best[begin][0] + scores[piece], best[begin][1] + 1
                if word[end - 1] not in scores and (top is None or best[end - 1][0] + unknown > top[0]):
                    top = best[end - 1][0] + unknown, best[end - 1][1] + len(word[end - 1].encode())
                best.append(top)
            total += best[-1][1]
    return total


def test_counts_match_plain_python(spark):
    rnd = random.Random(6)
    letters = "abc"
    names = {"".join(rnd.choice(letters + "▁") for _ in range(rnd.randint(1, 6))) for _ in range(60)} | {"▁", "a"}
    pieces = [("<unk>", 0.0), *((p, rnd.choice([-1.0, -2.0, -0.5, 0.0])) for p in sorted(names) if "▁" not in p[1:])] + [(f"<0x{b:02X}>", -5.0) for b in range(256)]
    texts = ["".join(rnd.choice("aabbcc  \t\n▁éx") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, pieces).collect()}
    assert got == {i: plain(pieces, t) for i, t in enumerate(texts)}


def test_a_long_word_takes_little_memory(pieces):
    import tracemalloc

    counter = Counter(pieces)
    word = "▁" + "thequickbrown日" * 75_000
    tracemalloc.start()
    n = counter.word(word)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 5 << 20 and n > 75_000 * 3
