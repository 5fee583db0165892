"""Number and time functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words, and units that may stand with a number.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
UNITS = r"\b(cfm ?50|cfm ?25|ach ?50|cfm|ach|pa|percent|years?|yrs?|ppm|gal(lons?)?|btu/?h?|btu)\b"
#: Upper bounds of the bands, each inclusive, and the name beyond the last.
DEPTH_BANDS = ((0, "0"), (3, "1-3"), (6, "4-6"), (9, "7-9"), (12, "10-12"), (15, "13-15")), "16+"
AGE_BANDS = ((5, "0-5"), (10, "6-10"), (15, "11-15"), (20, "16-20"), (25, "21-25"), (30, "26-30"), (35, "31-35")), "36+"


def clamped(c: Column) -> Column:
    """Between 0 and 1; what is no finite number is 0, and so is null."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def band(c: Column, bands: tuple) -> Column:
    """The band of a number; negative or infinite ones are an error, null has none."""
    bounds, beyond = bands
    out = F.when(c.isNull(), None).when(F.isnan(c) | (c < 0) | (c == float("inf")), F.raise_error("number out of range").cast("string"))
    for top, name in bounds:
        out = out.when(c <= top, name)
    return out.otherwise(beyond)


def jitter_window(attempts: Column, base_ms: float, cap_ms: float) -> Column:
    """Upper end of the random wait after so many attempts."""
    return F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(32))))


def jitter_delay(attempts: Column, base_ms: float, cap_ms: float, random: Column | None = None) -> Column:
    """A wait spread evenly over its window; random is a column in [0, 1), the session's own by default."""
    return F.floor(jitter_window(attempts, base_ms, cap_ms) * (F.rand() if random is None else random))


def total_backoff(retries: Column, base_ms: float, cap_ms: float) -> Column:
    """The longest that so many waits can take together."""
    waits = F.when(retries > 0, F.sequence(F.lit(0), (retries - 1).cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.aggregate(waits, F.lit(0.0), lambda total, k: total + F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), k)))


def most_retries(budget_ms: float, attempt_ms: float, base_ms: float, cap_ms: float, limit: int = 64) -> int:
    """Retries whose worst case, attempts and waits, fits the budget; 0 if not even one attempt does."""
    spent, n = attempt_ms, 0
    while n < limit and spent + min(cap_ms, base_ms * 2**n) + attempt_ms <= budget_ms:
        spent += min(cap_ms, base_ms * 2**n) + attempt_ms
        n += 1
    return n


def hedge_delay(predicted: Column, budget_ms: float, factor: float = 1.5, least_ms: float = 2000, most_ms: float = 30000) -> Column:
    """When to start the second engine: after the budget if nothing is predicted, else within bounds around the prediction."""
    return F.when(predicted.isNull(), float(budget_ms)).otherwise(F.least(F.lit(float(most_ms)), F.greatest(F.lit(float(least_ms)), predicted * factor)))


def near(x: Column, y: Column) -> Column:
    """Equal up to a millionth, or a thousand-millionth near 0."""
    return F.abs(x - y) <= F.greatest(F.lit(1e-9), 1e-6 * F.greatest(F.abs(x), F.abs(y)))


def speech_probability(logits: Column) -> Column:
    """1 less the softmax share of the first class; 0 without classes."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(F.size(logits) > 0, 1 - F.exp(F.get(logits, F.lit(0)) - top) / total).otherwise(0.0)


def frames(ms: Column, rate: int, step: int) -> Column:
    """A duration in whole frames, one at least."""
    return F.greatest(F.lit(1), F.floor(ms / 1000 * rate / step + 0.5)).cast("long")


def sample_of(frame: Column, step: int, offset: int) -> Column:
    return frame * step + offset


def fingerprint(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def version_parts(c: Column, width: int = 4) -> Column:
    """A dotted version as numbers to compare, missing parts 0."""
    parts = F.transform(F.split(c, r"\."), lambda x: F.coalesce(F.expr("0") + F.try_to_number(x, F.lit("999999")).cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), width)), 1, width)


def percent(n: Column, d: Column) -> Column:
    """A share in percent with one decimal, or n/a."""
    return F.when(d == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", 100.0 * n / d), F.lit("%")))


def after_ms(at: Column, ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms.cast("int"), at)


def _words_value(tokens: Column) -> Column:
    """The sum that number words say, with hundred and thousand; null if another word is among them."""
    numbers = F.create_map(*(F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, float(v))))

    def step(acc: Column, t: Column) -> Column:
        n = F.try_element_at(numbers, t)
        now, or_one = acc["now"], F.when(acc["now"] == 0, 1.0).otherwise(acc["now"])
        known = n.isNotNull() | t.isin("and", "hundred", "thousand")
        return F.struct(
            F.when(t == "thousand", acc["total"] + or_one * 1000).otherwise(acc["total"]).alias("total"),
            F.when(t == "thousand", 0.0).when(t == "hundred", or_one * 100).when(n.isNotNull(), now + n).otherwise(now).alias("now"),
            (acc["ok"] & known).alias("ok"),
            (acc["seen"] | (known & (t != "and"))).alias("seen"),
        )

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(True).alias("ok"), F.lit(False).alias("seen"))
    return F.aggregate(tokens, start, step, lambda a: F.when(a["ok"] & a["seen"], a["total"] + a["now"]))


def spoken_number(c: Column) -> Column:
    """A number written with units, commas, percent or an R before it, or in words; what follows "point" in words is left out, and words add up ("nineteen eighty" is 99)."""
    s = F.regexp_replace(F.trim(F.lower(c)), r"^r-?\s*", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[,%]", ""), UNITS, ""))
    head = F.split(s, r"\bpoint\b")[0]
    tokens = F.filter(F.split(head, r"[\s-]+"), lambda t: t != "")
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double")).otherwise(_words_value(tokens))


def download_size(model: Column, sizes: Column, fallback: int, addend: int, with_addend: Column) -> Column:
    """Bytes to fetch for a model, by a map of known sizes; what is not known counts as the fallback. The addend is for what comes with every model."""
    return F.coalesce(F.try_element_at(sizes, model), F.lit(fallback)) + F.when(with_addend, addend).otherwise(0)


def retries_that_fit(requested: Column, batches: Column, budget_ms: float, attempt_ms: float, base_ms: float, cap_ms: float) -> Column:
    """The most retries, up to those requested, whose worst case (attempts and waits of every batch) fits the budget; 0 if none does."""
    fits = F.filter(F.sequence(F.lit(0), F.greatest(requested.cast("int"), F.lit(0))), lambda r: batches * ((r + 1) * attempt_ms + total_backoff(r, base_ms, cap_ms)) <= budget_ms)
    return F.coalesce(F.array_max(fits), F.lit(0))


def iso_instant(at: Column | None = None) -> Column:
    """An instant as ISO 8601 in UTC with milliseconds; by default that of the query's start, which is one for all rows."""
    utc = F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
