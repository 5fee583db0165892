import hashlib
import random
import re

from attestra.llm.personal_data import digest, luhn, masked, trusted_patterns, with_personal_data

DIGITS = re.compile("[0-9]")


def n_digits(s):
    return len(DIGITS.findall(s))


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-")), lambda s: 12 <= n_digits(s) <= 19 and luhn("".join(DIGITS.findall(s)).encode())),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= n_digits(s) <= 15),
)


def base(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m[0])]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found)), [sum(x[1] == k for x in found) for k in range(4)]


def run(spark, texts):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r.doc_id: r for r in digest(with_personal_data(frame)).collect()}


def test_luhn():
    assert luhn(b"4111111111111111") and not luhn(b"4111111111111112") and luhn(b"378282246310005")


def test_base_matches_brute_force(spark):
    rnd = random.Random(11)
    parts = ["a", "b.c", "@", "@x", ".", ".com", " ", "-", "+", "+1", "é", "192", "255", "256", "0", "1", ".1", "4111 1111", "1111", "4111-1111-1111-1111", "(", ")", "%", "_", "\n", "00007", "5500005555555559"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    texts += [None, "", "9" * 30_000, "a" * 50_000, "a" * 50_000 + "@", "@" * 3000, "1." * 10_000, "+1 " * 9000, "1.2.3.4.5.6.7.8.9", "x@y.z@a.b", "+12345 678901"]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        want, n = base(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == n
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))


def test_contexts_discover_identifiers(spark):
    rnd = random.Random(2)
    card = lambda: next(x for x in iter(lambda: "".join(rnd.choice("0123456789") for _ in range(16)), None) if luhn(x.encode()))
    texts = [f"my card {card()} expires soon" for _ in range(8)] + ["é my card 4111111111111112 expires soon", "lot 4111111111111112 was sold"]
    got = run(spark, texts + ["my card 1234123412341231 expires soon"])
    assert got[10].spans == "context:8:24" and got[8].spans == "context:10:26" and not got[9].spans
    assert all(got[i].n_card == 1 and got[i].n_context == 0 for i in range(8))


def test_masked_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "é write a@b.co or 10.0.0.1!", 5), (2, "clean", 5), (None, None, None), (1, "é write a@b.co or 10.0.0.1!", 5)], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in masked(docs).collect())
    assert got[1] == got[2] == (1, "é write <EMAIL> or <IP>!", 24) and got[3] == (2, "clean", 5) and got[0][1] is None
    assert with_personal_data(docs.limit(0)).count() == 0


def test_contexts_discover_other_shapes_groups_and_long_strings(spark):
    texts = [f"write to u{i}@site{i}.org for help" for i in range(9)]
    texts += ["write to AB-123456 for help", "write to 123 45 6789 for help", f"write to {'9x' * 400} for help", "write to 4111 1111. 22 for help", "see AB-123456 there now"]
    got = run(spark, texts)
    assert got[9].spans == "context:9:18" and got[10].spans == "context:9:20" and got[11].spans == "context:9:809"
    assert not got[12].spans and not got[13].spans


def test_scores_match_plain_python(spark):
    rnd = random.Random(8)
    edges = {(f"p{rnd.randint(0, 11)}", f"i{rnd.randint(0, 39)}"): None for _ in range(150)}
    seeds = {f"i{k}" for k in range(26)}
    frame = spark.createDataFrame([(p.encode(), i.encode(), i in seeds) for p, i in edges for _ in range(2)], "pattern binary, instance binary, seed boolean")
    for rounds, trust, least in ((1, 0.5, 3), (3, 0.55, 4), (5, 0.6, 2)):
        own = {p: {i for q, i in edges if q == p} for p, _ in edges}
        own = {p: x for p, x in own.items() if len(x & seeds) >= least}
        belief = dict.fromkeys(seeds, 1.0)
        for _ in range(rounds):
            score = {p: sum(belief.get(i, 0.0) for i in x) / (len(x) + 1) for p, x in own.items()}
            for i in {i for x in own.values() for i in x} - seeds:
                doubt = 1.0
                for p in (p for p, x in own.items() if i in x):
                    doubt *= 1 - min(score[p], 0.999)
                belief[i] = 1 - doubt
        got = {bytes(r.pattern).decode() for r in trusted_patterns(frame, rounds, trust, least).collect()}
        assert got == {p for p, s in score.items() if s >= trust}
