"""Text functions as Columns. Byte and Unicode rules differ on purpose; each docstring says which applies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folds() -> tuple[str, str]:
    """Lower-case letters and what the index has for them; marks beyond the second string's end are dropped.

    Latin letters lose a mark if they have exactly one; marks of their own are dropped where such a letter has them.
    Variants of a letter (long s, final sigma) become the letter.
    """
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()}
    plain = {a: d[0] for a, d in parts.items() if len(d) == 2 and d[0].isascii() and d[0].isalpha()}
    marks = {parts[a][1] for a in plain}
    same = {a: a.casefold() for a in map(chr, range(0x80, 0x530)) if a.isalpha() and a.islower() and len(a.casefold()) == 1 and a.casefold() != a}
    plain |= same | {"\u1e9b": "s"}
    return "".join(plain) + "".join(sorted(marks)), "".join(plain.values())


MARKED, PLAIN = _folds()


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


#: Unicode's White_Space, which is what (?U)\s is.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def unicode_trim(x: Column) -> Column:
    """x without white space at its ends; only the ends are looked at, no pattern tries every place of a long text."""
    return F.trim(x, F.lit(SPACES))


def compact_whitespace(x: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed. Lone spaces, nearly all runs, are passed over."""
    return F.trim(F.regexp_replace(x, r"(?U)(?! (?!\s))\s+", " "))


def tokenize_query(x: Column) -> Column:
    """A question's terms: runs of letters, digits and _-./:@#, ASCII lower case, first occurrences."""
    parts = F.split(x, r"[^\p{IsAlphabetic}\p{N}_\-./:@#]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda t: t != ""), ascii_lower))


def fold(x: Column) -> Column:
    """Unicode lower case; Latin letters with one mark lose it, those with several keep them (see _folds)."""
    low = F.lower(x)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, MARKED, PLAIN))  # ASCII has no marks


def index_tokens(x: Column) -> Column:
    """The full-text analysis: runs of letters and digits of the folded text."""
    return F.array_remove(F.split(fold(x), r"[^\p{L}\p{N}]+"), "")


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def stable_id(x: Column) -> Column:
    """The first 16 hex digits of the content hash."""
    return F.substring(F.sha2(x, 256), 1, 16)


def token_estimate(x: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(x) / 4).cast("long")
