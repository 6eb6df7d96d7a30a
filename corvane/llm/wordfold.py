"""Vectorised word normalisation shared by the overlap operators.

A word is a run of letters and digits. Case, accents and invisible format characters do not
count; the dotted and dotless forms of i are one letter. Texts are folded in batches as
arrays of code points, so the cost per character is a few table look-ups.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SPACE, BREAK = 32, 1  #: separator between words; border between texts
_LOOP_END = 0x3400  #: below this every code point is looked up one by one
_TABLE_END = 0x30000


def _fold_char(c: str) -> int:
    """Folded code point of ``c``; 0 drops it, SPACE separates words."""
    if c in "Iıİ":
        return ord("i")
    kind = unicodedata.category(c)
    if kind[0] == "M" or kind == "Cf":
        return 0
    if kind[0] not in "LN":
        return SPACE
    base = [x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M"]
    one = base[0] if len(base) == 1 else c
    low = one.casefold()
    return ord(low) if len(low) == 1 else ord(one.lower()[0])


@lru_cache(maxsize=1)
def table() -> np.ndarray:
    t = np.full(_TABLE_END, SPACE, dtype=np.uint32)
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2FFFF)):
        t[lo:hi] = np.arange(lo, hi, dtype=np.uint32)
    for lo, hi in ((0, _LOOP_END), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10000, 0x12000), (0x1D400, 0x1D800), (0x1E000, 0x1F000)):
        for i in range(lo, hi):
            t[i] = _fold_char(chr(i))
    t[BREAK] = SPACE
    return t


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fold ``texts`` into one array ``SPACE w SPACE w SPACE BREAK SPACE w ...``.

    Returns the folded code points, for each the offset of its character within its own
    text, and for each text the index of its first entry (one more entry ends the last).
    """
    joined = "\x01".join(t.replace("\x01", " ") for t in texts)
    codes = np.frombuffer(f"\x01{joined}\x01".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    border = np.zeros(len(codes), dtype=bool)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    borders = np.concatenate(([0], np.cumsum(lengths + 1)))
    border[borders] = True
    f = table()[np.minimum(codes, _TABLE_END - 1)]
    keep = np.flatnonzero(f)
    f = f[keep]
    sep = f == SPACE
    # one separator between words; a border keeps one of its own, see below
    first = np.empty(len(f), dtype=bool)
    first[0] = True
    first[1:] = ~(sep[1:] & sep[:-1]) | border[keep][1:]
    f, at = f[first], keep[first]
    isb = border[at]
    # a border reads SPACE BREAK SPACE: widen it by two entries
    reps = np.where(isb, 3, 1)
    # separators next to a border are dropped, the widened border supplies them
    sep = f == SPACE
    near = np.zeros(len(f), dtype=bool)
    near[1:] |= isb[:-1]
    near[:-1] |= isb[1:]
    reps[sep & near & ~isb] = 0
    out = np.repeat(f, reps)
    pos = np.repeat(at, reps)
    bpos = np.cumsum(reps) - reps
    out[bpos[isb] + 1] = BREAK
    start = bpos[isb] + 2
    text_no = np.searchsorted(borders, pos, side="right") - 1
    return out, pos - borders[np.minimum(text_no, len(borders) - 1)] - 1, start


def words(text: str) -> list[str]:
    """The folded words of one text, in order."""
    if text.isascii():
        raw = text.lower()
        return "".join(c if c.isalnum() else " " for c in raw).split()
    t, out = table(), []
    for c in text:
        v = t[min(ord(c), _TABLE_END - 1)]
        if v:
            out.append(chr(v))
    return "".join(out).split()
