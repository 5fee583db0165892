"""String functions on columns: normal forms, quotes in texts, labels, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by the Unicode property.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def straight_quotes(c: Column) -> Column:
    """Curly quotation marks made straight."""
    return F.translate(c, "‘’“”", "''\"\"")


def compact_key(c: Column) -> Column:
    """Lower-case letters and digits only, for loose comparison of values."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def loose_text(c: Column) -> Column:
    """Lower case, straight quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "‘’“”" + _WHITE, "''\"\"" + " " * len(_WHITE)), "  +", " "))


def bare_text(c: Column) -> Column:
    """Of a loose text, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9 ]+", ""), " +", " "))


def spoken_text(c: Column) -> Column:
    """The form in which transcripts are compared: letters, digits, apostrophes and single spaces."""
    return F.trim(F.regexp_replace(straight_quotes(F.lower(c)), "[^a-z0-9']+", " "))


def words(c: Column) -> Column:
    """Words between spaces, of a text in one of the forms above; none in an empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def spoken_words(c: Column) -> Column:
    return words(spoken_text(c))


def same_value(a: Column, b: Column) -> Column:
    """Equal up to form; of more than two characters each, one may be part of the other."""
    x, y = compact_key(a), compact_key(b)
    return (x == y) | ((F.length(x) > 2) & (F.length(y) > 2) & (F.contains(x, y) | F.contains(y, x)))


def right_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WHITE))


def is_grounded(span: Column, text: Column) -> Column:
    """A quote that isn't blank and that the text has, up to white space at the quote's end; a null quote isn't grounded."""
    t = right_trimmed(span)
    return F.coalesce((F.length(t) > 0) & F.contains(text, t), F.lit(False))


def is_verbatim(span: Column, text: Column) -> Column:
    """The scorer's rule: unlike is_grounded, a quote of nothing but white space passes."""
    return F.coalesce((F.length(span) > 0) & (F.contains(text, span) | F.contains(text, right_trimmed(span))), F.lit(False))


def span_class(span: Column, text: Column, longest: int = 6, shortest: int = 4) -> Column:
    """verbatim; near-miss: loose, bare, or with a fragment of `shortest` to `longest` words; or fabricated."""

    def near(x: Column) -> Column:
        w = words(x["span"])
        # a fragment of more words has one of the fewest in it
        fragments = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - shortest + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, shortest), " "))
        some = (F.size(w) >= shortest) & F.exists(fragments, lambda f: F.contains(x["text"], f))
        return F.contains(x["text"], x["span"]) | F.contains(bare_text(x["text"]), bare_text(x["span"])) | some

    forms = F.struct(loose_text(span).alias("span"), loose_text(text).alias("text"))
    found = F.transform(F.array(forms), near)[0]  # the forms are made once, and only where the quote is not verbatim
    return F.when(is_verbatim(span, text), "verbatim").when((F.length(span) > 0) & found, "near-miss").otherwise("fabricated")


def member_slug(c: Column) -> Column:
    """An enumeration's literal as a name: without a leading percentage, quotes and signs."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[0-9]+%\s*-\s*", "")), "['\"]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def split_camel(c: Column) -> Column:
    """Spaces at changes of case and between letters and digits."""
    x = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(x, "([a-zA-Z])([0-9])", "$1 $2"), "([0-9])([A-Z])", "$1 $2")


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def leaf_label(path: Column) -> Column:
    """A field's path as a label; a group's name at the start of the leaf's is left out."""
    group, leaf = F.substring_index(path, ".", 1), F.regexp_replace(path, r"^[^.]*\.", "")
    within = F.contains(path, F.lit(".")) & (F.length(leaf) > F.length(group)) & F.startswith(F.lower(leaf), F.lower(group))
    own = F.substr(leaf, F.length(group) + 1)
    return sentence_case(split_camel(F.when(within, own).otherwise(leaf)))


def escaped(c: Column) -> Column:
    """Safe within HTML and within templates that take double braces."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("{{", "&#123;&#123;"), ("}}", "&#125;&#125;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chunk_name(source: Column, chunk: Column, part: Column) -> Column:
    """Names that sort as their numbers; a number too large for its width is an error."""
    fits = (chunk >= 0) & (chunk < 1_000_000) & (part >= 0) & (part < 100)
    name = F.concat_ws("-", F.lit("audio"), source.cast("string"), F.lpad(chunk.cast("string"), 6, "0"), F.lpad(part.cast("string"), 2, "0"))
    return F.when(fits, name).otherwise(F.raise_error("chunk number out of range").cast("string"))


def is_chunk_of(name: Column, source: Column) -> Column:
    return F.startswith(name, F.concat(F.lit("audio-"), source.cast("string"), F.lit("-")))


def path_label(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, r"\."), lambda p: sentence_case(split_camel(p))), " · ")


def model_short_name(c: Column) -> Column:
    """Without the owner before a slash and the format's suffix."""
    return F.regexp_replace(F.regexp_replace(c, "^.*/", ""), "(?i)-onnx$", "")


def engine_id(prefix: str, model: Column, device: Column, kind: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), model_short_name(model), F.coalesce(device, F.lit("auto")), F.coalesce(kind, F.lit("auto")))


def hint_prompt(vocabulary: Column, prompt: Column) -> Column:
    """The words to listen for and a free text, or null if there is nothing."""
    terms = F.array_join(F.filter(F.transform(vocabulary, lambda t: F.trim(t)), lambda t: t != ""), ", ")
    parts = F.array(F.when(F.size(vocabulary) > 0, terms), F.when(F.trim(prompt) != "", F.trim(prompt)))
    return F.nullif(F.trim(F.array_join(F.array_compact(parts), ". ")), F.lit(""))


def phrases(vocabulary: Column) -> Column:
    """Trimmed and without blanks; null if none is left."""
    kept = F.filter(F.transform(vocabulary, lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(kept) > 0, kept)


def located(issues: Column) -> Column:
    """Issues (path, message) as one line."""
    return F.array_join(F.transform(issues, lambda x: F.concat_ws(": ", F.when(x["path"] != "", x["path"]), x["message"])), "; ")


def sentences(text: Column) -> Column:
    """Pieces that end with marks, within lines, trimmed; blanks left out."""
    found = F.regexp_extract_all(text, F.lit(r"([^.!?\n]+[.!?]*)"))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def packed(parts: Column, budget: int) -> Column:
    """Parts joined by spaces in order into as few pieces as a word budget allows; a longer part stands alone."""
    count = lambda s: F.size(F.split(s, r"\s+"))

    def step(acc: Column, s: Column) -> Column:
        n = count(s)
        full = (acc["n"] > 0) & (acc["n"] + n > budget)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def padded_words(c: Column) -> Column:
    """Words between single spaces, with one at each end, so that whole words can be looked for."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def file_label(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")


def elapsed(ms: Column) -> Column:
    """Minutes, seconds and tenths."""
    whole = F.floor(ms / 1000)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("."), F.floor((ms % 1000) / 100).cast("string"))


def byte_size(n: Column) -> Column:
    """In units of 1024: whole bytes, kB with one decimal, MB and GB with two."""
    of = lambda k, d: F.format_string(f"%.{d}f", n / float(1024**k))
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(of(1, 1), F.lit(" kB")))
            .when(n < 1024**3, F.concat(of(2, 2), F.lit(" MB"))).otherwise(F.concat(of(3, 2), F.lit(" GB"))))


def url_kind_suffix(url: Column, kinds: list[str]) -> Column:
    """The number format that a model file's name ends with, the longest that fits."""
    ordered = sorted(kinds, key=lambda k: (-len(k), k))
    return F.nullif(F.regexp_extract(url, "(" + "|".join(ordered) + r")\.onnx", 1), F.lit(""))
