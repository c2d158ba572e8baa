"""How often phrases are in texts, without a string for each token: texts of Latin-1 in arrays of their bytes.

The analysis is that of text.index_tokens. Its rules are tabled for U+0000 to U+00FF, whose letters are settled; a text with
any other character gets null, and is left to index_tokens itself.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MARKED, PLAIN

#: Texts that are looked through at once, and bytes of whole texts that are cut at once.
PART, PART_BYTES = 256, 1 << 19


@cache
def letters() -> tuple[bytes, dict[str, int]]:
    """A code for the folded letter or digit of each character of Latin-1, 0 for those that part tokens; and the codes' letters."""
    fold = dict(zip(MARKED, PLAIN, strict=False))  # PLAIN is shorter: marks, which Latin-1 has none of
    kept = [fold.get(x, x) for x in (chr(c).lower() for c in range(256))]
    token = {x for x in kept if unicodedata.category(x)[0] in "LN"}
    codes = {x: i for i, x in enumerate(sorted(token), 1)}
    return bytes(codes.get(x, 0) for x in kept), codes


def _text(text: bytes | None) -> str | None:
    try:
        return None if text is None else text.decode()
    except UnicodeError:
        return None


def _latin(text: str | None) -> bytes | None:
    try:
        return None if text is None else text.encode("latin-1")
    except UnicodeError:
        return None


def _texts(texts: pa.Array) -> list[str | None]:
    """None for null and for what is no UTF-8."""
    try:
        return texts.to_pylist()
    except UnicodeError:
        return [_text(t) for t in texts.cast(pa.binary()).to_pylist()]


def _bounds(made: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of texts of Latin-1 in a row, where each token begins and ends among them, and where each text ends."""
    ends = np.cumsum([1, *[len(t or b"") + 1 for t in made]])[1:]
    folded = np.frombuffer(b"\n".join([b"", *[t or b"" for t in made], b""]).translate(letters()[0]), np.uint8)
    inside = folded != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # both ends part tokens
    return folded, edges[::2], edges[1::2], ends


def coded_tokens(texts: pa.Array, others: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Index tokens, each distinct one held once; and of each text where its tokens begin among them, and how many they are.

    others: lists with the tokens of texts that are not of Latin-1, null for those that are.
    """
    given = others.is_valid().to_numpy(zero_copy_only=False)
    folded, begin, end, ends = _bounds([None if g else _latin(t) for t, g in zip(_texts(texts), given, strict=True)])
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    spelt = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(folded[folded != 0])]).dictionary_encode()
    words = codecs.charmap_decode(b"\0".join(spelt.dictionary.to_pylist()), "strict", "\0" + "".join(letters()[1]))[0].split("\0") if len(begin) else []
    both = pa.chunked_array([pa.DictionaryArray.from_arrays(spelt.indices, pa.array(words, pa.string())), others.flatten().dictionary_encode()])
    size, more = np.diff(np.searchsorted(begin, ends), prepend=0), pc.list_value_length(others).fill_null(0).to_numpy()
    at = np.where(given, len(begin) + np.cumsum(more) - more, np.cumsum(size) - size)
    return both.unify_dictionaries().combine_chunks(), at, size + more


def beyond_latin(text: Column) -> Column:
    """Whether text has a character that is not of Latin-1."""
    return text.rlike("[^\\x00-\\xFF]")


def _tokens(made: list[bytes | None], words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of Latin-1 whether there is one, and where its tokens end among all; of each token its word's number, from
    1 on, or 0."""
    codes = letters()[1]
    folded, begin, end, ends = _bounds(made)
    of = np.zeros(len(begin), np.int16)
    spelt = {i: [codes.get(x) for x in word] for i, word in enumerate(words, 1)}
    spelt = {i: x for i, x in spelt.items() if None not in x}  # no text of Latin-1 has the others
    most = max(map(len, spelt.values()), default=0) + 1
    alike = np.zeros((256, most + 1), bool)  # first letter and size of a word
    alike[[x[0] for x in spelt.values()], [len(x) for x in spelt.values()]] = True
    few = np.flatnonzero(alike[folded[begin], np.minimum(end - begin, most)])
    first, size = folded[begin[few]], (end - begin)[few]
    for i, letter in spelt.items():
        at = few[(first == letter[0]) & (size == len(letter))]
        for j, x in enumerate(letter[1:], 1):
            at = at[folded[begin[at] + j] == x]
        of[at] = i
    return np.array([t is not None for t in made], bool), np.searchsorted(begin, ends), of


def _per_text(ends: np.ndarray, codes: np.ndarray, words: int) -> np.ndarray:
    """How often each word (from 1 on) is in each text."""
    at = np.flatnonzero(codes)
    cells = np.searchsorted(ends, at, "right") * (words + 1) + codes[at]
    return np.bincount(cells, minlength=len(ends) * (words + 1)).reshape(len(ends), words + 1)[:, 1:]


def _frequencies(heads: list[bytes | None], texts: list[bytes | None], whose: np.ndarray, phrases: list[list[str]], times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """d, tf and whether they hold, of each text after the head whose number is in whose."""
    words = sorted({w for p in phrases for w in p})
    number = {w: i for i, w in enumerate(words, 1)}
    known, ends, codes = _tokens([*heads, *texts], words)
    size, found = np.diff(ends, prepend=0), _per_text(ends, codes, len(words))
    n = len(heads)
    d, in_head, in_text = size[whose] + times * size[n:], found[whose], found[n:]
    tf = np.zeros((len(texts), len(phrases)), np.int32)
    part = lambda i: codes[ends[i - 1] if i else 0 : ends[i]]
    for k, phrase in enumerate(phrases):
        code = [number[w] for w in phrase]
        of = [c - 1 for c in code]
        if len(code) == 1:
            tf[:, k] = in_head[:, of[0]] + times * in_text[:, of[0]]
            continue
        for i in np.flatnonzero(((in_head + in_text)[:, of] > 0).all(axis=1)):  # texts with all its words
            whole = np.concatenate([part(whose[i]), *[part(n + i)] * times])
            starts = max(len(whole) - len(code) + 1, 0)
            tf[i, k] = np.logical_and.reduce([whole[j : j + starts] == c for j, c in enumerate(code)]).sum()
    return d, tf, known[n:] & known[whose]


def _lists(tf: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(tf) + 1, dtype=np.int32) * tf.shape[1], pa.array(tf.ravel(), pa.int32()))


def frequencies(heads: pa.Array, texts: pa.Array, phrases: list[list[str]], times: int) -> pa.Array:
    """d and tf, as retrieval.phrase_frequencies has them, of each head followed by times its text; null for those not tabled."""
    made = [[_latin(t) for t in _texts(x)] for x in (heads, texts)]
    d, tf, known = _frequencies(*made, np.arange(len(texts)), phrases, times)
    return pa.StructArray.from_arrays([pa.array(d, pa.int32()), _lists(tf)], ["d", "tf"], mask=pa.array(~known))


def chunk_frequencies(heads: pa.Array, texts: pa.Array, phrases: list[list[str]], times: int, cut: Callable[[str], list[str]]) -> pa.Array:
    """d and tf of each chunk that cut makes of a text, after the text's head, or else the chunk, where it is not tabled; null for
    a text that is null or no UTF-8."""
    cuts = [None if t is None else cut(t) for t in _texts(texts)]
    chunks, sizes = [c for x in cuts for c in x or ()], [len(x or ()) for x in cuts]
    front, made, whose = [_latin(h) for h in _texts(heads)], [_latin(c) for c in chunks], np.repeat(np.arange(len(cuts)), sizes)
    counts = []
    for at in range(0, len(chunks), PART):
        of = whose[at : at + PART]
        counts.append(_frequencies(front[of[0] : of[-1] + 1], made[at : at + PART], of - of[0], phrases, times))
    d, tf, known = map(np.concatenate, zip(*counts, strict=True)) if counts else (np.zeros(0), np.zeros((0, len(phrases)), np.int32), np.zeros(0, bool))
    rest = pa.array([None if k else c for c, k in zip(chunks, known, strict=True)], pa.string())
    found = pa.StructArray.from_arrays([pa.array(d, pa.int32()), _lists(tf)], ["d", "tf"], mask=pa.array(~known))
    rows = pa.StructArray.from_arrays([found, rest], ["counts", "text"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), rows, mask=pa.array([x is None for x in cuts], pa.bool_()))


COUNTS = "struct<d:int,tf:array<int>>"


def phrase_counts(head: Column, text: Column, phrases: list[list[str]], times: int) -> Column:
    """struct<d, tf>: see frequencies. A worker looks through PART texts and hands their counts on."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for heads, texts in batches:
            for at in range(0, len(texts), PART):
                yield frequencies(heads.slice(at, PART), texts.slice(at, PART), phrases, times)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, COUNTS)(head, text)


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of texts with PART_BYTES or little more; a longer text is alone or the last of its run."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES)) + 1
        yield at, min(end, len(ends)) - at
        at = end


def chunk_texts(text: Column, cut: Callable[[str], list[str]]) -> Column:
    """array<string>: the chunks that cut makes of a text; null for a text that is null or no UTF-8. A worker cuts PART_BYTES of
    texts and hands their chunks on."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at, n in parts(texts):
                yield pa.array([None if t is None else cut(t) for t in _texts(texts.slice(at, n))], pa.list_(pa.string()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")(text)


def chunk_counts(head: Column, text: Column, phrases: list[list[str]], times: int, cut: Callable[[str], list[str]]) -> Column:
    """array<struct<counts, text>>: see chunk_frequencies. A worker cuts PART_BYTES of texts and hands their counts on."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for heads, texts in batches:
            for at, n in parts(texts):
                yield chunk_frequencies(heads.slice(at, n), texts.slice(at, n), phrases, times, cut)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"array<struct<counts:{COUNTS},text:string>>")(head, text)
