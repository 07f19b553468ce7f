"""Cutting texts at white space, where the tokenizer's vocabulary never joins anything."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

# str.split() also cuts at the four separators 1C-1F, which are not Unicode white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PART_BYTES = 4 << 20


def split_words(text: str) -> list[str]:
    """Runs of characters that are not Unicode white space."""
    if _SEPARATORS.search(text):
        return [word for word in _WHITE.split(text) if word]
    return text.split()


def parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``most`` bytes, NULL as empty; one long text may be more."""
    first, texts, size = 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def trimmed(cache: dict, new: Iterable, most: int) -> list:
    """The keys of ``new`` that the cache lacks; a full cache is emptied first, so its size stays bounded."""
    new = set(new)
    if len(cache) + len(new) > most:
        cache.clear()
    return [key for key in new if key not in cache]
