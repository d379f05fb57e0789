"""String similarities from 0 to 100, all built on the longest common subsequence.

The one thing Spark has no expression for is the length of that subsequence, so that alone is an Arrow
function (bit-parallel, after Hyyro 2004). Pairs whose shorter side has at most 64 characters go together through one
numpy step for each character; longer ones take one integer of as many bits as the longer side has characters, whose places are made once for
all pairs of a batch that have it. The ratio
of word sets is one such function as well: as expressions, its sets would be made again for every use of the column.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.normalize import words


class Places(dict):
    """By letter: the bits of an integer at which a text has it, made when asked for."""

    def __init__(self, text: str):
        super().__init__()
        self.size, self.codes = len(text), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def __missing__(self, letter: str) -> int:
        self[letter] = bits = int.from_bytes(np.packbits(self.codes == ord(letter), bitorder="little").tobytes(), "little")
        return bits


def lcs(a: str, b: str, places: Places | None = None) -> int:
    """Length of the longest common subsequence; ``places`` are those of the longer text, of ``b`` if both are as long.

    The longer text is the integer, so that there are as few steps as the shorter has characters.
    """
    if a == b:
        return len(a)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places = Places(b) if places is None else places
    full = (1 << len(b)) - 1
    row = full
    for at in range(0, len(a), 64):  # carries add a bit a step at most, which are cut off now and then
        for c in a[at:at + 64]:
            hit = row & places[c]
            row = row + hit | row ^ hit
        row &= full
    return len(b) - row.bit_count()


#: Pairs that go through numpy together, and cells of their table of letters.
_TOGETHER, _CELLS = 4096, 1 << 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and where each begins."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes


def _short_lcs(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of many pairs; every ``a`` has 1 to 64 characters, and the ``b`` are in order of length, the longest first."""
    n = len(a)
    (x, x0), (y, y0) = _codes(a), _codes(b)
    letters, code = np.unique(x, return_inverse=True)
    size = np.fromiter((len(t) for t in a), np.int64, n)
    row = np.repeat(np.arange(n), size)
    masks = np.zeros((n, len(letters) + 1), np.uint64)  # the last column is for letters that no ``a`` has
    np.bitwise_or.at(masks, (row, code), np.uint64(1) << (np.arange(len(x)) - x0[row]).astype(np.uint64))
    at = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
    other = np.where(letters[at] == y, at, len(letters))
    state = np.full(n, ~np.uint64(0))
    longest = np.fromiter((len(t) for t in b), np.int64, n)
    reach = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), side="right")  # pairs that have a j-th character
    for j, k in enumerate(reach.tolist()):
        v = state[:k]
        hit = v & masks[np.arange(k), other[y0[:k] + j]]
        state[:k] = (v + hit) | (v - hit)
    return 64 - np.bitwise_count(state).astype(np.int64)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of a[i] and b[i] for all i; pairs that occur again are computed once."""
    pairs = list(zip(a, b))
    known: dict[tuple[str, str], int] = {}
    short, long = [], []
    for p in dict.fromkeys(pairs):
        x, y = p if len(p[0]) <= len(p[1]) else p[::-1]
        if x == y or not x:
            known[p] = len(x)
        elif len(x) <= 64:
            short.append((x, y, p))
        else:
            long.append((y, x, p))
    last, places = None, None
    for y, x, p in sorted(long):
        if y != last:
            last, places = y, Places(y)
        known[p] = lcs(x, y, places)
    short.sort(key=lambda s: -len(s[1]))
    at = 0
    while at < len(short):
        part = short[at:at + _TOGETHER]
        letters = len(set().union(*(s[0] for s in part))) + 1
        part = part[:max(1, min(_TOGETHER, _CELLS // letters))]
        found = _short_lcs([s[0] for s in part], [s[1] for s in part])
        known.update((s[2], n) for s, n in zip(part, found.tolist()))
        at += len(part)
    return np.fromiter((known[p] for p in pairs), np.int64, len(pairs))


def _windows(a: str, b: str) -> list[str]:
    """Windows of ``b`` as long as ``a``, and shorter ones at its ends."""
    n = len(a)
    return [b[max(0, end - n):end] for end in range(1, len(b) + n)]


def best_windows(a: list[str], b: list[str]) -> list[float]:
    """Best indel similarity of the shorter string and any window of the longer that is as long, or shorter at its ends; both ways if they are as long as each other."""
    memo: dict[tuple[str, str], float] = {}
    todo: list[tuple[tuple[str, str], str, list[str]]] = []
    held = 0

    def flush() -> None:
        left = [s for _, s, w in todo for _ in w]
        right = [x for *_, w in todo for x in w]
        found = lcs_lengths(left, right).tolist()
        at = 0
        for p, s, w in todo:
            best = max(200.0 * n / (len(s) + len(x)) for n, x in zip(found[at:at + len(w)], w))
            memo[p] = max(memo.get(p, 0.0), best)
            at += len(w)
        todo.clear()

    for p in dict.fromkeys(zip(a, b)):
        x, y = p if len(p[0]) <= len(p[1]) else p[::-1]
        if not x or x in y:
            memo[p] = 100.0 if x or not y else 0.0
            continue
        for s, t in ((x, y), (y, x)) if len(x) == len(y) else ((x, y),):
            todo.append((p, s, _windows(s, t)))
            held += (len(t) + len(s)) * len(s)
        if held > 1 << 22:
            flush()
            held = 0
    if todo:
        flush()
    return [memo[p] for p in zip(a, b)]


def _pairwise(kernel, kind: str):
    """An Arrow function over two columns from a kernel over two lists."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kernel(a.tolist(), b.tolist()), dtype="int64" if kind == "long" else "float64")

    over.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, kind)


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def lcs_length(a: Column, b: Column) -> Column:
    return _pairwise(lcs_lengths, "long")(_text(a), _text(b))


def ratio(a: Column, b: Column) -> Column:
    """Normalised indel similarity; two empty strings are alike."""
    a, b = _text(a), _text(b)
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / n)


def sorted_words(x: Column) -> Column:
    return F.array_join(F.array_sort(words(x)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_words(a), sorted_words(b))


WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Characters of the texts whose sets of words are held.
_SETS = 1 << 23


def token_sets(a: list[str], b: list[str]) -> list[float]:
    """Words as sets: 100 if one holds the other, 0 if one is empty, else the best of three ratios.

    All three strings begin with the shared words, so one subsequence (of the two rests) decides them all. None is computed where the other
    two ratios are as good as the first could be if the shorter rest were whole in the longer, which is common for texts of different lengths.
    """
    sets: dict[str, tuple[frozenset[str], int]] = {}
    held = 0

    def words_of(text: str) -> tuple[frozenset[str], int]:
        nonlocal held
        if text not in sets:
            if held > _SETS:
                sets.clear()
                held = 0
            held += len(text)
            found = frozenset(WORDS.findall(text))
            sets[text] = found, sum(map(len, found))
        return sets[text]

    out, left, right, rest = [0.0] * len(a), [], [], []
    for i, pair in enumerate(zip(a, b)):
        (x, x_size), (y, y_size) = map(words_of, pair)
        if not x or not y:
            continue
        both = x & y
        if both and len(both) in (len(x), len(y)):
            out[i] = 100.0
            continue
        size = sum(map(len, both))
        n = size + len(both) - 1 if both else 0
        p, q = x_size - size + len(x) - len(both) - 1, y_size - size + len(y) - len(both) - 1
        head = n + 1 if both else 0
        out[i] = max(200.0 * n / (2 * n + 1 + p), 200.0 * n / (2 * n + 1 + q)) if both else 0.0
        if 200.0 * (head + min(p, q)) / (2 * head + p + q) > out[i]:
            left.append(" ".join(sorted(x - both)))
            right.append(" ".join(sorted(y - both)))
            rest.append((i, head, 2 * head + p + q))
    for (i, head, whole), k in zip(rest, lcs_lengths(left, right).tolist()):
        out[i] = max(out[i], 200.0 * (head + k) / whole)
    return out


def token_set_ratio(a: Column, b: Column) -> Column:
    """``token_sets`` of two columns."""
    return _pairwise(token_sets, "double")(_text(a), _text(b))


def with_token_set(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``pairs`` with the token set ratio of two columns."""
    return pairs.withColumn(name, token_set_ratio(F.col(a), F.col(b)))


def partial_ratio(a: Column, b: Column) -> Column:
    return _pairwise(best_windows, "double")(_text(a), _text(b))
