"""Text expressions: blanks, missing tokens, preparation, tokens, n-grams, previews."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_letters, ascii_lowercase, digits

from pyspark.sql import Column, functions as F

from topicloom.constants import NA_TOKENS, PREVIEW_CHARS

# Whitespace as Unicode-aware stripping defines it; TRIM would only drop U+0020.
BLANK_PATTERN = r"^[\s\x0B\x1c-\x1f\x85\p{Z}]*$"
EDGE_SPACE_PATTERN = r"^[\s\x0B\x1c-\x1f\x85\p{Z}]+|[\s\x0B\x1c-\x1f\x85\p{Z}]+$"
LINE_BREAK_PATTERN = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"
# Classes that list their characters compile to a bit set, several times faster than ranges.
NOT_KEPT = f"[^{ascii_letters}{digits} ]+"
NOT_WORD = f"[^{ascii_lowercase}{digits}_]+"
UNICODE_TOKEN = r"[\p{L}\p{N}_]{2,}"
SENTENCE_BREAK = r"[.!?\n]+"
EMPTY_DOCUMENT = "emptydoc"


def na_to_null(c: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """NULL for strings that stand for a missing value."""
    return F.when(~c.isin(list(tokens)), c)


def is_blank(c: Column) -> Column:
    """True where nothing is left after stripping Unicode whitespace."""
    return c.cast("string").rlike(BLANK_PATTERN)


def has_text(c: Column) -> Column:
    """True for values that are neither NULL nor blank."""
    return c.isNotNull() & ~is_blank(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE_PATTERN, "")


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    """First characters followed by an ellipsis, which short texts get as well."""
    return F.concat(F.substring(c, 1, chars), F.lit("..."))


def prepare(c: Column, language: str = "english") -> Column:
    """Single-line text for keyword extraction; English keeps ASCII letters and digits only."""
    space = F.lit(" ")
    flat = F.replace(F.replace(c, F.lit("\n"), space), F.lit("\t"), space)
    if language != "english":
        return flat
    kept = F.regexp_replace(flat, NOT_KEPT, "")
    return F.when(kept == "", F.lit(EMPTY_DOCUMENT)).otherwise(kept)


def tokens(c: Column, language: str = "english") -> Column:
    """Lower-cased tokens of at least two word characters, in order."""
    if language != "english":
        return F.regexp_extract_all(F.lower(c), F.lit(UNICODE_TOKEN), F.lit(0))
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda w: F.length(w) > 1)


def prepared_words(
    c: Column, language: str = "english", stop_words: Sequence[str] = ()
) -> Column:
    """Tokens of the prepared text without stop words."""
    if language != "english":
        return drop_stop_words(tokens(prepare(c, language), language), stop_words)
    # Preparation leaves only letters, digits and spaces, so a plain split finds the tokens.
    stop = list(stop_words)
    return F.filter(
        F.split(F.lower(prepare(c)), " "),
        lambda w: (F.length(w) > 1) & ~w.isin(stop) if stop else F.length(w) > 1,
    )


def drop_stop_words(words: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return words
    stop = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stop))


def with_bigrams(words: Column) -> Column:
    """The words followed by the pairs of neighbouring words."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), rest),
        F.slice(words, F.lit(2), rest),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def sentences(c: Column) -> Column:
    """Trimmed non-empty sentences."""
    return F.filter(
        F.transform(F.split(c, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != ""
    )


def numbered_lines(items: Column) -> Column:
    """"1. first", "2. second" and so on, one per line."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )


def single_line(c: Column) -> Column:
    """Stripped text with each line break turned into one space."""
    return strip(F.regexp_replace(strip(c), LINE_BREAK_PATTERN, " "))
