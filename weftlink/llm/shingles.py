"""Word shingles of whole batches of texts as 64-bit hashes, and probability-Jaccard signatures of them."""

from __future__ import annotations

import hashlib

import numpy as np

#: Lower-cased texts to words: a-z, 0-9 and everything outside ASCII stay, the rest becomes a blank.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (Steele et al., 2014)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def normal_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8").translate(_WORD_BYTES)


def fingerprint(blob: bytes) -> bytes:
    """128 bits of the sequence of words."""
    return hashlib.blake2b(b" ".join(blob.split()), digest_size=16).digest()


def _word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of the first word of each text (and the end).

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums, so that a batch
    needs no loop over words.
    """
    data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    lengths = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
    heads = np.cumsum(lengths) - lengths
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.concatenate([np.searchsorted(starts, heads), [len(starts)]])


def shingle_sets(blobs: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles (sorted hashes) and their counts. A text of fewer words has one shingle of them all."""
    if not blobs:
        return []
    words, first = _word_hashes(blobs)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + words[k:k + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1], return_counts=True))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _STEP + w
            out.append((mix(np.asarray([h], np.uint64)), np.ones(1, np.int64)))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
    return out


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    """Probability Jaccard; with unit weights, the Jaccard of the two sets."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if not weighted:
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    v, w = a[1].astype(np.float64), b[1].astype(np.float64)
    # sum over j of max(v_j / v_i, w_j / w_i): v_j / v_i for those whose ratio v / w is at least that of i, else w_j / w_i
    ratio = v[ia] / w[ib]
    order = np.argsort(ratio, kind="stable")
    low = np.concatenate([[0.0], np.cumsum(w[ib][order])])
    high = np.concatenate([[0.0], np.cumsum(v[ia][order])])
    only_v, only_w = v.sum() - high[-1], w.sum() - low[-1]
    at = np.searchsorted(ratio[order], ratio, side="left")
    total = (only_v + high[-1] - high[at]) / v[ia] + (only_w + low[at]) / w[ib]
    return float((1 / total).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int, seed: int, weighted: bool) -> np.ndarray:
    """ProbMinHash signatures (Ertl, 2020): (texts, m) of 64-bit element hashes; rows without elements are 0.

    Every element sends points at exponential distances, at a rate of its weight, each to a random
    component; a component keeps the element of its earliest point. Points later than a limit can't
    matter once every component has one before it, so an element stops at the limit. The limit
    is what fills all components but for rare texts, which go on to a later one.
    """
    out = np.zeros((len(sets), m), np.uint64)
    todo = [i for i, s in enumerate(sets) if len(s[0])]
    spare = np.log(m) + 6
    while todo:
        sizes = np.fromiter((len(sets[i][0]) for i in todo), np.int64, len(todo))
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(np.float64) if weighted else np.ones(len(element))
        row = np.repeat(np.arange(len(todo)), sizes)
        limit = (m * spare / np.bincount(row, weight, len(todo)))[row]
        state = mix(element ^ np.uint64(seed))
        at = np.zeros(len(element))
        slots, times, names = [], [], []
        while len(element):
            state = state + _GOLDEN
            bits = mix(state)
            at = at - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            go = at <= limit
            element, weight, row, limit, state, at, bits = element[go], weight[go], row[go], limit[go], state[go], at[go], bits[go]
            slots.append(row * m + (mix(bits ^ _STEP) % np.uint64(m)).astype(np.int64))
            times.append(at)
            names.append(element)
        slot, time, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        earliest = np.full(len(todo) * m, np.inf)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        own = np.zeros(len(todo) * m, np.uint64)
        own[slot[won]] = name[won]
        own, full = own.reshape(len(todo), m), np.isfinite(earliest.reshape(len(todo), m)).all(1)
        for k in np.flatnonzero(full):
            out[todo[k]] = own[k]
        todo = [i for i, f in zip(todo, full) if not f]
        spare *= 3
    return out
