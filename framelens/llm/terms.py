"""Terms of UTF-8 text as byte spans, and their bytes packed into machine words.

A class of characters is a table over bytes: every byte of a character beyond ASCII has its highest bit set, so a class
that holds all such characters is decided byte by byte.
"""

from __future__ import annotations

import numpy as np

#: ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``: ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z is lower case: digits as well.
WORDS = LETTERS.copy()
WORDS[0x30:0x3A] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document number of every longest run of bytes of a ``kind``; none crosses a document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(offsets, starts, side="right") - 1


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place as one big-endian word; zeros behind the end. A view, not eight copies."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray(len(data) + 9, ">u8", padded, strides=(1,))


def packed(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: int = 0) -> np.ndarray:
    """Bytes ``8 * word`` to ``8 * word + 7`` of every span of ``eights``, zeros behind the span's end.

    Order of words is order of bytes; spans without zero bytes that fit their words are equal where the words are.
    """
    left = np.clip(lengths - 8 * word, 0, 8)
    unused = np.minimum((8 - left) * 8, 56).astype(np.uint64)
    held = view[np.minimum(starts + 8 * word, len(view) - 1)].astype(np.uint64)
    return np.where(left > 0, held >> unused << unused, np.uint64(0))


def radix_order(*words: np.ndarray) -> np.ndarray:
    """Stable order by words, the first counting most: one counting pass per 16-bit digit, from the last digit on."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16-bit numbers
    return order
