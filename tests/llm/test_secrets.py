import hashlib
import random
import re

import zstandard

from attestra.llm.secrets import IDENTIFIERS, digest, secrets

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def base(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found)), [sum(x[1] == k for x in found) for k in range(3)]


def run(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in digest(secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string"))).collect()}


def test_base_matches_brute_force(spark):
    rnd = random.Random(3)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", "  ", '"', "'", "é", "x", "AKIA", "AKIAAB", "ABCDEFGHIJKL12", "0123456789abcdef", "ff", "secret=", "/", "\n", "abcdefgh", "KIA", "-", "."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "a" * 60_000, "0" * 31, "AKIA" * 5000, "password=" + "z" * 50_000, "token" * 20_000, "password" + " " * 20_000]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        want, n = base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == n
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))


def test_novel_strings(spark):
    rnd = random.Random(5)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    got = run(spark, [f"the bearer {key} was sent", f"word {key} stands alone here", f"auth {'abcdefghijklmnopqrstuvwxyz0123456789'} ok", f"{key} and again with auth {key}", "é auth " + key])
    assert got[0].spans == "novel:11:51" and got[4].spans == "novel:7:47"
    assert not got[1].spans and not got[2].spans and not got[3].spans


def test_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets(none).count() == 0
    twice = spark.createDataFrame([(None, "AKIA" + "A" * 20), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted(r.n_access for r in digest(secrets(twice)).collect()) == [0, 0, 1]


def test_keys_of_letters_alone(spark):
    rnd = random.Random(6)
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(32))
    got = run(spark, [f"the bearer {key} was sent", "the key responsibilities/characterisation of it", "auth Uncharacteristically wrong", "key 12345678901234567890 wrong"])
    assert got[0].spans == "novel:11:43" and not any(got[k].spans for k in (1, 2, 3))
    small = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(48))
    got = run(spark, [f"the key {small} was sent", "secret " + "abcdefghijklmnopqrstuvwxyz" * 2, f"the word {small[:39]} alone, key {small[:39]}", f"no such word before {small}"])
    assert got[0].spans == "novel:8:56" and not any(got[k].spans for k in (1, 2, 3))


def test_novelty_matches_zstandard_alone(spark):
    """Every candidate of a text against a plain reading of the rule."""
    rnd = random.Random(9)
    parts = ["auth ", "key: ", "word ", "x" * 20 + "1 ", "configuration_value1 ", "Some plain text. ", "\n", "x" * 50 + " ", "the_quick_brown_fox_jumps_over_the_lazy_dog_and_the_quick_fox "]
    random_key = lambda: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rnd.randint(12, 40))) + " "
    texts = ["".join(rnd.choice([*parts, random_key()]) for _ in range(12)) for _ in range(60)]
    for i, r in run(spark, texts).items():
        text, want = texts[i], []
        taken = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s and not s.startswith("novel")]
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            word, near = m[0], text[max(0, m.start() - 40) : m.start()]
            kinds = re.search("[0-9]", word) and not word.isdigit() or re.search("[a-z]", word) and re.search("[A-Z]", word[1:])
            if not (kinds or len(word) >= 40) or not re.search("pass|pwd|secret|token|key|auth|bearer|credential|private|signature|login|session", near, re.I):
                continue
            primer = zstandard.ZstdCompressionDict(IDENTIFIERS + text[m.end() : m.end() + 256].encode() + text[max(0, m.start() - 256) : m.start()].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = lambda x, d=primer: len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
            if press(word.encode()) - press(b"") >= 0.6 * len(word) and all(m.end() <= a or b <= m.start() for a, b in taken):
                want.append(f"novel:{m.start()}:{m.end()}")
        assert [s for s in r.spans.split(",") if s.startswith("novel")] == want
