"""Column expressions on sentences, tokens and texts. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MASK = "<mask>"
TYPOGRAPHIC = "’‘“”–­"
PLAIN = "''\"\"--"
ALMOST_SAME_PREFIX = 20
CHARS_PER_TOKEN = 4

SENTENCE = r"[^.!?]+[.!?]*"
TOKEN = "[a-z0-9]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def flatten_lines(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\r\n]+", " "))


def sentences(text: Column) -> Column:
    """Sentences in order, inner whitespace squeezed, blank ones left out."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    tidy = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(tidy, lambda s: s != "")


def sentence_bodies(text: Column) -> Column:
    """The variant that splits at end marks and drops the marks."""
    return F.filter(F.transform(F.split(text, "[.!?]"), strip), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between full stops."""
    return F.size(F.filter(F.split(text, r"\."), lambda s: strip(s) != "")).cast("long")


def tokens(x: Column) -> Column:
    """Lower-case alphanumeric runs."""
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def words(x: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x)).cast("long")


def ngrams2(toks: Column) -> Column:
    """Neighbouring token pairs of a token array, joined by a blank."""
    return F.when(
        F.size(toks) > 1,
        F.zip_with(
            F.slice(toks, F.lit(1), F.size(toks) - 1),
            F.slice(toks, F.lit(2), F.size(toks) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def other_sentences(sents: Column, sid: Column) -> Column:
    """All sentences but one, joined by a blank."""
    return F.array_join(F.filter(sents, lambda s, i: i != sid), " ")


def cut_first(text: Column, part: Column) -> Column:
    """``text`` without the first occurrence of ``part``; later occurrences stay.

    One search for the quoted part, which skips ahead by its length, gives what stands before and after it.
    """
    part = F.lit(part) if isinstance(part, str) else part
    quoted = F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.coalesce(F.array_join(F.split(text, quoted, 2), ""), text)


def masked(sents: Column, sid: Column) -> Column:
    return F.array_join(F.transform(sents, lambda s, i: F.when(i == sid, F.lit(MASK)).otherwise(s)), " ")


def unmask(document: Column, summary: Column) -> Column:
    return F.replace(document, F.lit(MASK), summary)


def with_mask_sentence(sents: Column, position: int) -> Column:
    at = F.least(F.lit(position), F.size(sents)) + 1
    return F.array_join(F.array_insert(sents, at, F.lit(MASK)), " ")


def plain_quotes(x: Column) -> Column:
    """Typographic quotes, en dash and soft hyphen as plain characters, outer whitespace off."""
    return strip(F.translate(x, TYPOGRAPHIC, PLAIN))


def almost_same(a: Column, b: Column) -> Column:
    n = ALMOST_SAME_PREFIX
    return (F.length(a) == F.length(b)) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def token_estimate(x: Column) -> Column:
    return F.floor(F.length(x) / CHARS_PER_TOKEN).cast("long")


def one_per_line(text: Column) -> Column:
    return F.array_join(sentences(text), "\n")


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def r6(x: Column) -> Column:
    """Six decimals; NaN becomes NULL."""
    return F.round(F.nanvl(x.cast("double"), F.lit(None).cast("double")), 6)


def hex_number(digest: Column, start: int, width: int) -> Column:
    """``width`` hex digits of a digest as a number."""
    return F.conv(F.substring(digest, start, width), 16, 10).cast("long")


def keyed_digest(*parts) -> Column:
    """md5 over the parts joined by colons; the same in every engine."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
