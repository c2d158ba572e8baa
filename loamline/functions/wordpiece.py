"""Word pieces: words of folded text, each cut into the longest pieces that a vocabulary has."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

#: Fixed values of vocabularies of this kind.
UNKNOWN, FIRST, LAST, PADDING, INSIDE = "[UNK]", "[CLS]", "[SEP]", "[PAD]", "##"
LONGEST_WORD = 100
#: Code points of ideographs, each of which is a word.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _is_mark(c: str) -> bool:
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c).startswith("P")


def words_of(text: str) -> list[str]:
    """Lower-case words without accents; marks and ideographs are words of their own, control characters are dropped."""
    clean = []
    for c in text:
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            clean.append(" ")
        elif c not in "\0�" and kind not in ("Cc", "Cf", "Cn", "Co"):
            clean.append(f" {c} " if any(a <= ord(c) <= b for a, b in IDEOGRAPHS) else c)
    folded = "".join(c for c in unicodedata.normalize("NFD", "".join(clean)) if unicodedata.category(c) != "Mn").lower()
    return "".join(f" {c} " if _is_mark(c) else c for c in folded).split()


class WordPieces:
    """Ids of texts by a vocabulary: a piece a line, its id the line's number; pieces inside words begin with ##."""

    def __init__(self, pieces: Sequence[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        missing = [p for p in (UNKNOWN, FIRST, LAST) if p not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.longest = max(map(len, self.ids))

    def word(self, word: str) -> list[int]:
        """The ids of the longest pieces from the left; the unknown id where some rest has none."""
        found, at = [], 0
        while at < len(word) <= LONGEST_WORD:
            before = INSIDE if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                piece = self.ids.get(before + word[at:end])
                if piece is not None:
                    found.append(piece)
                    at = end
                    break
            else:
                return [self.ids[UNKNOWN]]
        return found or [self.ids[UNKNOWN]]

    def encode(self, text: str, limit: int) -> list[int]:
        """At most limit ids, the first and last marks among them."""
        found: list[int] = []
        for word in words_of(text):
            if len(found) >= limit - 2:
                break
            found += self.word(word)
        return [self.ids[FIRST], *found[: limit - 2], self.ids[LAST]]
