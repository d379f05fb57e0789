"""Byte-level BPE encoding and decoding by a table of ranks.

Encoding has two tiers, both of which fold ranked merges over the bytes of distinct words: the adjacent
pair of the lowest rank becomes one piece, until no pair has a rank.

1. The commonest distinct words of a bounded sample are encoded by Spark higher-order functions
   (``fold_words``): the fold's state is the pieces and the ranks of neighbours, and the rank map is a
   literal, cut into slots by a hash so that a look-up doesn't search it. The result, of bounded size, is
   broadcast.
2. Workers cut batches of texts before blanks, number the distinct chunks, cut those into words, take what the
   table has, and fold the other distinct words themselves, through a bounded cache. Nothing is shuffled.

Decoding is a higher-order function over the ids that concatenates the pieces' bytes.

Defined cases: a null text is an empty one and has no ids; a text of any length is encoded whole, in memory that grows with the longest; special strings are ordinary text; repeated rows and
null ids keep their rows; extra columns are ignored; an empty table gives no rows; ids that no piece has decode to null.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.cache import BoundedCache
from weftlink.llm.common import texts

#: Unicode white space, spelled out, since engines differ in what their shorthand takes.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = 2147483647
_SLOTS = 1 << 16
#: By a word's bytes, the width of those it is folded together with.
_WIDTH = [next(w for w in (4, 6, 8, 10, 12, 16, 24, 32, 48, 64) if w >= n) for n in range(65)]
_TOGETHER = 20_000  #: words folded together at most

#: A blank after other white space that is also before white space or at the end: there, cutting before each blank isn't exact.
_INEXACT = rf"[{SPACE}] (?:[{SPACE}]|\z)"


@dataclass(frozen=True)
class BpeParams:
    ranks: str  #: path of a rank file (base64 piece, rank) on every machine
    pattern: str  #: splits texts before the merges
    table_size: int = 30_000  #: words of the broadcast table at most
    sample_words: int = 300_000  #: words in texts that they come from; doesn't change any id
    table_bytes: int = 32  #: longest word of the table
    cache: int = 600_000  #: encoded words that a worker remembers at most; of chunks between blanks two thirds as many
    batch_bytes: int = 8 << 20  #: texts encoded together are no longer, unless it is one text


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: slots of maps from hexadecimal pieces to ranks."""
    import xxhash

    slots: list[dict[str, int]] = [{} for _ in range(_SLOTS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        slots[xxhash.xxh64_intdigest(key.encode(), seed=42) % _SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def fold_column(word: Column, literal: Column) -> Column:
    """Ids of one word: its bytes with ranked merges folded over them."""

    def encode(table: Column, h: Column) -> Column:
        rank = lambda piece: _let(piece, lambda x: F.coalesce(table[F.pmod(F.xxhash64(x), F.lit(_SLOTS)).cast("int")][x], F.lit(_NONE)))
        n = (F.length(h) / 2).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        pieces = F.transform(at, lambda i: F.substr(h, i * 2 + 1, F.lit(2)))
        ranks = F.transform(at, lambda i: F.when(i < n - 1, rank(F.substr(h, i * 2 + 1, F.lit(4)))).otherwise(_NONE))

        def merged(s: Column, k: Column, piece: Column) -> Column:
            """Pieces k and k + 1 (from 1) become one; only the ranks beside it change."""
            own = F.when(k + 1 < F.size(s["p"]), rank(F.concat(piece, F.get(s["p"], k + 1)))).otherwise(_NONE)
            beside = F.when(k > 1, F.array(rank(F.concat(F.get(s["p"], k - 2), piece)), own)).otherwise(F.array(own))
            return F.struct(
                F.concat(F.slice(s["p"], F.lit(1), k - 1), F.array(piece), F.slice(s["p"], k + 2, F.size(s["p"]))).alias("p"),
                F.concat(F.slice(s["r"], F.lit(1), F.greatest(k - 2, F.lit(0))), beside, F.slice(s["r"], k + 2, F.size(s["r"]))).alias("r"))

        def step(s: Column, _: Column) -> Column:
            at_lowest = lambda low: _let(F.array_position(s["r"], low).cast("int"), lambda k: _let(F.concat(F.get(s["p"], k - 1), F.get(s["p"], k)), lambda piece: merged(s, k, piece)))
            return _let(F.array_min(s["r"]), lambda low: F.when(low == _NONE, s).otherwise(at_lowest(low)))

        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.struct(pieces.alias("p"), ranks.alias("r")), step, lambda s: F.transform(s["p"], lambda x: rank(x)))
        return _let(rank(h), lambda whole: F.when(whole != _NONE, F.array(whole)).otherwise(folded))

    return F.when(word == "", F.array().cast("array<int>")).otherwise(_let(literal, lambda table: _let(F.hex(word), lambda h: encode(table, h))))


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``words`` (word) with ids, by higher-order functions."""
    return words.select("word", fold_column(F.col("word"), rank_literal(ranks)).alias("ids"))


def jvm_pattern(pattern: str) -> str:
    """The pattern with white space spelled out, for Java's engine."""
    space = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


def frequent_words(text: DataFrame, p: BpeParams, ranks: dict[bytes, int]) -> dict[str, bytes]:
    """The broadcast tier: ids (little-endian, 32 bits) of the commonest distinct words of a bounded sample, the first ones of the table.

    ``take`` reads partitions until it has enough, so neither shuffle nor work grows with the table.
    """
    words = text.select(F.explode(F.regexp_extract_all("text", F.lit(jvm_pattern(p.pattern)), F.lit(0))).alias("word"))
    found = Counter(r[0] for r in words.where(F.octet_length("word").between(1, p.table_bytes)).take(p.sample_words))
    common = sorted(found, key=lambda w: (-found[w], w))[:p.table_size]
    if not common:
        return {}
    spark = text.sparkSession
    words = spark.createDataFrame([(w,) for w in common], "word string").repartition(max(1, spark.sparkContext.defaultParallelism))
    return {r["word"]: np.asarray(r["ids"], "<u4").tobytes() for r in fold_words(words, ranks).collect()}


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold of a long word in n log n: pairs wait in a heap by rank and place, pieces are a linked list."""
    n = len(word)
    start, end, left, right = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (rank := ranks.get(word[start[i]:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != to:
            continue  # the pair is gone
        alive[j] = False
        end[i], right[i] = to, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[word[start[i]:end[i]]] for i in range(n) if alive[i]]


class PairTable:
    """The same fold for many words together: which pieces side by side are a piece, in a hash table of arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.asarray([ranks[bytes([b])] for b in range(256)], np.int32)
        self.base = max(ranks.values()) + 1
        pairs = {ranks[w[:i]] * self.base + ranks[w[i:]]: rank for w, rank in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):  # of those that want a slot the last stays, the others go one further
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.ranks[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pieces make together, ``_NONE`` where that is no piece."""
        keys = left.astype(np.int64) * self.base + right
        at = self._slot(keys)
        out = self.ranks[at]
        off = np.flatnonzero(self.keys[at] != keys)
        out[off] = _NONE
        off = off[self.keys[at[off]] != -1]
        while len(off):
            at[off] = (at[off] + 1) % len(self.keys)
            met = self.keys[at[off]]
            same = met == keys[off]
            out[off[same]] = self.ranks[at[off[same]]]
            off = off[~same & (met != -1)]
        return out

    def fold(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of 2 to ``width`` bytes, little-endian, 32 bits."""
        n = np.fromiter(map(len, words), np.int32, len(words))
        pieces = self.bytes[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)]
        col = np.arange(width - 1, dtype=np.int32)
        beside = self.rank(pieces[:, :-1].ravel(), pieces[:, 1:].ravel()).reshape(len(words), width - 1)
        beside[col >= n[:, None] - 1] = _NONE
        rows, out, size = np.arange(len(words)), np.empty((len(words), width), "<i4"), n.copy()
        while len(rows):
            k = beside.argmin(1)
            low = beside[np.arange(len(rows)), k]
            done = low == _NONE
            out[rows[done]], size[rows[done]] = pieces[done], n[done]
            left = ~done
            pieces, beside, rows, n, k, low = pieces[left], beside[left], rows[left], n[left] - 1, k[left], low[left]
            each, behind = np.arange(len(rows)), col > k[:, None]
            pieces[:, :-1] = np.where(behind, pieces[:, 1:], pieces[:, :-1])
            pieces[each, k] = low
            beside[:, :-1] = np.where(behind[:, :-1], beside[:, 1:], beside[:, :-1])
            beside[:, -1] = _NONE
            beside[each, k] = np.where(k < n - 1, self.rank(low, pieces[each, k + 1]), _NONE)
            e, j = each[k > 0], k[k > 0]
            beside[e, j - 1] = self.rank(pieces[e, j - 1], low[k > 0])
        raw, step = out.tobytes(), 4 * width
        return [raw[i:i + 4 * m] for i, m in zip(range(0, len(raw), step), size.tolist())]


class Encoder:
    def __init__(self, p: BpeParams, table: dict[str, bytes] | None = None):
        import regex

        self.ranks = load_ranks(p.ranks)
        self.pairs = PairTable(self.ranks)
        spelled = p.pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.find = regex.compile(spelled).findall
        #: Whether a blank belongs to the word after it, so that texts can be cut before blanks (see ``_INEXACT``).
        self.by_blank = all(self.find(x) == w for x, w in (("a b", ["a", " b"]), ("a  b", ["a", " ", " b"]), ("a\n b", ["a", "\n", " b"]), ("1 .", ["1", " ."])))
        self.words = BoundedCache(lambda w: self.fold([w])[0], p.cache, table)
        self.chunks = BoundedCache(self.ids, p.cache * 2 // 3, keep=lambda c: len(c) < 40)

    def fold(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: whole pieces, words of like lengths together, and long words one by one."""
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(raw)
        alike: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = struct.pack("<I", whole)
            elif len(w) > 64:
                out[i] = np.asarray(_fold_long(w, self.ranks), "<u4").tobytes()
            else:
                alike.setdefault(_WIDTH[len(w)], []).append(i)
        for width, own in alike.items():
            for at in range(0, len(own), _TOGETHER):
                part = own[at:at + _TOGETHER]
                for i, ids in zip(part, self.pairs.fold([raw[i] for i in part], width)):
                    out[i] = ids
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, little-endian, 32 bits."""
        return b"".join(self.words.many(self.find(text), self.fold))

    def _cut(self, chunks: list[str]) -> list[bytes]:
        words = list(map(self.find, chunks))
        found = iter(self.words.many(list(chain.from_iterable(words)), self.fold))
        return [next(found) if len(own) == 1 else b"".join(islice(found, len(own))) for own in words]

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of all texts, and their ids one after another. Each distinct chunk is looked up once."""
        if not self.by_blank or pc.any(pc.match_substring_regex(column, _INEXACT), min_count=0).as_py():
            found = [self.ids(t) for t in column.to_pylist()]
            return np.asarray([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), "<i4")
        lists = pc.split_pattern(column, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        firsts = [chunks[k] for k in at[ends[:-1]]]  # no blank before them
        at[ends[:-1]] = np.arange(len(chunks), len(chunks) + len(firsts))
        pieces = self.chunks.many([" " + c for c in chunks] + firsts, self._cut)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        start = np.cumsum(size) - size
        n = size[at]
        until = np.cumsum(n)
        place = np.repeat(start[at] - (until - n), n)
        place += np.arange(len(place))
        counts = np.diff(np.concatenate([[0], until])[ends])
        return counts, np.frombuffer(b"".join(pieces), "<i4")[place]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows of ``most`` bytes at most, or of one row that is longer."""
    done = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1)
        yield at, to
        at = to


_ENCODERS: dict[tuple, Encoder] = {}


def encode(docs: DataFrame, params: BpeParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ids."""
    p = params
    text = texts(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(text, p, load_ranks(p.ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (p, len(table.value), hash(frozenset(table.value.items())))
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(p, table.value)
        enc = _ENCODERS[key]
        for batch in batches:
            for at, to in slices(batch.column(1), p.batch_bytes):
                counts, ids = enc.many(batch.column(1).slice(at, to - at))
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(ends, pa.array(ids))], names=["doc_id", "ids"])

    return text.mapInArrow(run, "doc_id long, ids array<int>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """Bytes of every id, in hexadecimal, as one literal."""
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: their pieces, concatenated."""
    pieces = piece_literal(ranks)
    whole = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
    return F.when(F.forall(ids, lambda i: F.get(pieces, i).isNotNull()), whole)
