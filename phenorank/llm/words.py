"""Words of many texts at once, as 64-bit hashes in numpy arrays: case, accents, marks, markup and odd characters don't count."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

from phenorank.llm.lookalike import by_table

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.{0,500}?-->")
_ODD = re.compile("[^\x00-ɏ̀-ͯḀ-ỿ ‐-‧ ‰-‾₠-⃀℃℉™！-､]")
_DASH = re.compile("[‐-―−‣•·  \x85]")

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def folded(text: str) -> bytes:
    """Lower-case ASCII of a text, with blanks where words end."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if _ODD.search(text):
            text = by_table(text)
        text = _DASH.sub(" ", text.lower().replace("đ", "d"))
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore")
    return text.lower().encode("ascii")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.empty(size, np.uint64)
            table[0] = 1
            at = 1
            step = base
            while at < size:  # doubling: the second half is the first times base**at
                table[at : 2 * at] = table[:at] * np.uint64(step)
                step = step * step & _MASK
                at *= 2
            _powers[name] = table
    return _powers["up"], _powers["down"]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of the text it stands in, its place in the joined texts)."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    inside = _WORD[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * up[: len(raw)], out=sums[1:])
    words = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(bounds, start, "right"), start


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, also those over the end of a text."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    factor = int(_MULT)
    for k in range(size):
        total += words[k : k + n] * np.uint64(factor | 1)
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
    return mixed(total)
