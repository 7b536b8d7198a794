"""Code points of a batch of texts as one array, with the place of each text in it."""

from __future__ import annotations

import unicodedata

import numpy as np

#: From this code point on (planes 4 to 16) there are no letters.
TOP = 0x40000


def decode(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return cp, heads[off]


_tables: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For each code point: that of its small letter, or 0 if it is no letter."""
    if "letters" not in _tables:
        table = np.zeros(TOP + 1, np.uint32)
        for c in range(TOP):
            ch = chr(c)
            if ch.isalpha() and unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                table[c] = ord(low[0])
        _tables["letters"] = table
    return _tables["letters"]


def small_letters(cp: np.ndarray) -> np.ndarray:
    return letter_table()[np.minimum(cp, TOP)]
