"""Text and time scalars (T1-T14). All are native expressions on the JVM side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"

#: Dependency labels of the older scheme and their universal counterparts; others stay as they are.
UNIVERSAL = {
    "acomp": "xcomp",
    "attr": "xcomp",
    "purpcl": "advcl",
    "abbrev": "appos",
    "num": "nummod",
    "quantmod": "advmod",
    "complm": "mark",
    "rel": "dep",
    "prep": "case",
    "possessive": "case",
    "nn": "compound",
    "number": "compound",
    "npadvmod": "nmod",
    "tmod": "nmod",
    "predet": "det",
    "preconj": "cc",
    "prt": "compound",
    "poss": "case",
}

#: A small default; the list is a parameter wherever it is used.
STOP_WORDS = tuple("a an and are as at be but by for from has have he in is it its of on or she that the their they this to was were will with you".split())
NEGATIONS = ("no", "not", "never", "none", "nor", "without", "cannot")


def created_at(c: Column) -> Column:
    """``Wed Aug 27 13:08:45 +0000 2008`` as a timestamp; the offset is ignored, what doesn't parse is null."""
    local = F.concat(F.substring(c, 5, 15), F.lit(" "), F.regexp_extract(c, r"(\d{4})\s*$", 1))
    return F.try_to_timestamp(local, F.lit("MMM dd HH:mm:ss yyyy"))


def stamp(c: Column, month: bool = False) -> Column:
    """A timestamp as 14 digits, or as yyyymm."""
    return F.date_format(c, "yyyyMM" if month else STAMP)


def from_stamp(c: Column) -> Column:
    """14 digits as a timestamp."""
    return F.try_to_timestamp(c, F.lit(STAMP))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds between two 14-digit strings; an end before its start is an error, a null part gives null."""
    diff = F.unix_timestamp(from_stamp(end)) - F.unix_timestamp(from_stamp(start))
    return F.when(diff < 0, F.raise_error(F.concat(F.lit("ends before it starts: "), start, F.lit(" "), end)).cast("long")).otherwise(diff)


def text_clean(c: Column, strict: bool = False) -> Column:
    """Per line, drops urls, hashed ids, mentions and marks, and squeezes white space. Empty or null gives null.

    Any 22-character word between blanks counts as a hashed id. ``strict`` also drops lines without a letter."""

    def line(x: Column) -> Column:
        for pattern, by in ((r"url: \S*", ""), (r"http\S*", ""), (r"@un:\s\S{22}\s", " "), (r"@\S+", " "), (r"\s\S{22}\s", " "), ("#", " "), (r"\s+", " ")):
            x = F.regexp_replace(x, pattern, by)
        return F.trim(x)

    lines = F.transform(F.split(c, "\n"), line)
    if strict:
        lines = F.filter(lines, lambda x: x.rlike("[a-zA-Z]"))
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(F.array_join(lines, "\n"))


def clean_or_null(c: Column) -> Column:
    """The cleaned text, null where nothing is left."""
    return F.nullif(text_clean(c), F.lit(""))


def words_only(c: Column) -> Column:
    """Non-word characters, tags and digits go; words of fewer than 3 characters too."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"[^\w\s]", " "), r"[0-9]+", "")
    return F.array_join(F.filter(F.split(F.trim(x), r"\s+"), lambda w: F.length(w) >= 3), " ")


def light_clean(c: Column) -> Column:
    """T5: urls go and white space is squeezed; the text comes out once."""
    x = F.regexp_replace(F.regexp_replace(c, r"url: \S*", ""), r"http\S*", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def sentence_words(c: Column, stop_words: Sequence[str] = STOP_WORDS, merged: Mapping[str, str] | None = None) -> Column:
    """T4: sentences of a text, each cleaned to its words: array<string>, empty sentences dropped.

    A rule-based stand-in for a language model: a sentence ends at ``. ! ?`` or a line feed, stop words go, words
    that begin with anything but a letter go, and ``merged`` joins names of several words."""
    x = F.regexp_replace(F.regexp_replace(c, r"url: \S*", ""), r"http\S*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"@un:\s\S{22}\s", " "), r"\s\S{22}\s", " ")
    stops = F.array(*[F.lit(w) for w in stop_words])

    def sentence(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^\w\s]", " "), "[0-9]+", ""), r"\s+", " ")
        kept = F.filter(F.split(F.trim(s), " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, F.lower(w)) & w.rlike("^[a-zA-Z]"))
        out = F.array_join(kept, " ")
        for name, joined in (merged or {}).items():
            out = F.regexp_replace(out, name, joined)
        return out

    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[.!?\n]+"), sentence), lambda s: F.length(s) > 0)


def banded_sentences(c: Column, least: int = 5, most: int = 20) -> Column:
    """A text's sentences of so many words, words joined by a space; a sentence ends at ``. ! ?`` or a line feed. Null has none."""
    words = F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?\n]+"), lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return F.transform(F.filter(words, lambda ws: F.size(ws).between(least, most)), lambda ws: F.array_join(ws, " "))


def without_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS, exempt: Sequence[str] = NEGATIONS) -> Column:
    """Tokens but for stop words; negations are never stop words."""
    drop = [w for w in stop_words if w not in set(exempt)]
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*drop))


def universal_label(c: Column) -> Column:
    """The universal name of a dependency label, or itself."""
    table = F.create_map(*[F.lit(x) for pair in UNIVERSAL.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def float_vector(c: Column) -> Column:
    """Comma-separated numbers as array<float>; what isn't a number is null."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("float"))


def split_lines(c: Column) -> Column:
    """A text's lines, without carriage returns; null has none."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, "\r", ""), "\n"))


def token_ids(tokens: Column, ids: Column) -> Column:
    """Tokens as ids by a map column; unknown tokens go."""
    return F.filter(F.transform(tokens, lambda t: F.element_at(ids, t)), lambda i: i.isNotNull())


def bit_vector(ids: Column, size: int) -> Column:
    """Ids from 0 as an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.array_contains(ids, i), F.lit(False)).cast("int"))


def shuffled(tokens: Column, seed: int) -> Column:
    """Tokens in an order that only the seed and each token's text and place decide."""
    indexed = F.transform(tokens, lambda t, i: F.struct(F.xxhash64(F.lit(seed), t, i).alias("h"), t.alias("t")))
    return F.transform(F.array_sort(indexed), lambda s: s["t"])
