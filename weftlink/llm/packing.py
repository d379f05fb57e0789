"""Best-fit packing of tokenised documents into fixed-size sequences, by hierarchical residual packing.

1. Every input partition is tokenised once. Documents longer than a sequence are cut into full
   pieces (the first piece takes what doesn't fill one). Pieces, without their ids unless those are
   asked for, are dealt over as many partitions by a hash of their number, so that long and short ones
   meet wherever they stood in the input; full pieces are sequences of their own, and all other pieces
   are packed best-fit, longest first, inside the partition.
2. Bins that are nearly full are final. Underfull bins become items: groups, ``fan_in`` times fewer at
   each level, merge theirs best-fit, again emit nearly full bins, and hand all others up the tree.
3. At the top there is one group, or as many as it takes for none to hold much more than ``group`` bins: then what is left
   is final. Best-fit loses one bin for a group or so, one in ``group``, at any size of the corpus; no bin is closed
   before it has reached the top.

Only bin descriptions (a few integers for each underfull bin) travel up the tree; pieces are written
to the shared folder before and after they are dealt, and pieces in final bins are shuffled only then.

Defined cases: a null or empty text is a document of one end-of-document id; repeated rows are packed
each on its own; a null doc_id stays null; extra columns are ignored; an empty table packs into
nothing. The same input partitions give the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import staged, texts


@dataclass(frozen=True)
class PackParams:
    tokenizer: str  #: path of a tokenizers .json file on every machine
    capacity: int = 1024
    end_id: int = 2  #: appended to every document
    slack: int = 8  #: a bin with no more room than this is nearly full
    fan_in: int = 8
    group: int = 50_000  #: underfull bins that one task merges, but for chance
    flush: int = 200_000  #: pieces that are packed together at most in a partition


class IdEncoder:
    """Ids of a byte-level tokenizers file as little-endian unsigned 32-bit integers.

    If the file's merges stand in the order of the ids that they make, and nothing but the byte-level
    pattern looks at a text, its vocabulary is a table of ranks, and a rank encoder gives the library's
    own ids several times faster (the tests hold the two against each other). Otherwise the library encodes.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = self._rank_encoder(spec)

    @staticmethod
    def _rank_encoder(spec: dict):
        import public_tokenizers
        import tiktoken

        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
                 and not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")))
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if not plain or made != sorted(made):
            return None
        # the byte-level alphabet: printable characters stand for themselves, other bytes for 256 onward
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {x["content"]: x["id"] for x in added}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.ranks is None:
            return self.whole(text)
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """One encoder for each worker process; it lives on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, offset in it, fill of each bin).

    Open bins are kept by the room they have; bit r of ``open_`` says whether any has room r, so the
    tightest fit is found by shifting one integer.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    open_ = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = open_ >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, capacity - room
        fill[b] = capacity - room + size
        if room > size:
            rooms[room - size].append(b)
            open_ |= 1 << (room - size)
    return bins, offsets, np.asarray(fill, np.int64)


CUT = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = "bin_id long, bin_offset long, bin_fill long, grp long"


def _cut_partition(batches: Iterator[pd.DataFrame], p: PackParams, keep_ids: bool) -> Iterator[pd.DataFrame]:
    """The pieces of each document; ``key`` numbers them."""
    enc = encoder(p.tokenizer)
    end = int(p.end_id).to_bytes(4, "little")
    key = TaskContext.get().partitionId() << 33
    cap = p.capacity
    for pdf in batches:
        rows: list[tuple] = []
        ids: list[bytes] = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            buf = enc.ids(text) + end
            n = len(buf) // 4
            doc = None if doc_id is None or doc_id != doc_id else int(doc_id)
            at = 0
            to = n % cap or cap if n > cap else n
            piece = 0
            while at < n:
                own = buf[4 * at:4 * to]
                rows.append((key, doc, piece, at, to - at, zlib.crc32(own)))
                key += 1
                if keep_ids:
                    ids.append(own)
                at, to, piece = to, to + cap, piece + 1
        if rows:
            keys, docs, piece, start, length, crc = zip(*rows)
            out = pd.DataFrame({
                "key": keys, "doc_id": pd.array(docs, dtype="Int64"), "piece": np.asarray(piece, "int32"), "start": start, "length": length, "ids_crc32": crc})
            if keep_ids:
                out["ids"] = [np.frombuffer(x, "<u4").astype("int32") for x in ids]
            yield out


def _pack_partition(batches: Iterator[pa.RecordBatch], p: PackParams) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    next_bin = part << 33

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal next_bin
        rows = pa.Table.from_batches(held)
        bins, offsets, fill = best_fit(rows["length"].to_numpy(), p.capacity)
        for name, x in (("bin_id", bins + next_bin), ("bin_offset", offsets), ("bin_fill", fill[bins]), ("grp", np.full(len(bins), part))):
            rows = rows.append_column(name, pa.array(x, pa.int64()))
        next_bin += len(fill)
        yield from rows.to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= p.flush:
            yield from flush(held)
            held = []
    if held:
        yield from flush(held)


BINS = "bin_id long, cur long, shift long, fill long, grp long, final boolean"


def _merge_group(pdf: pd.DataFrame, p: PackParams, top: bool) -> pd.DataFrame:
    """Pack a group's underfull bins as items. Rows are bins of the first level; ``cur`` is what each is part of by now."""
    pdf = pdf.sort_values(["cur", "bin_id"], kind="stable").reset_index(drop=True)
    cur, first = np.unique(pdf["cur"].to_numpy(), return_index=True)
    fills = pdf["fill"].to_numpy()[first]
    bins, offsets, fill = best_fit(fills, p.capacity)
    name = np.full(len(fill), np.iinfo(np.int64).max)
    np.minimum.at(name, bins, cur)
    done = fill >= p.capacity - p.slack
    if top:
        done[:] = True
    at = np.searchsorted(cur, pdf["cur"].to_numpy())
    return pdf.assign(cur=name[bins[at]], shift=pdf["shift"] + offsets[at], fill=fill[bins[at]], final=done[bins[at]])


def _merger(p: PackParams, top: bool):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge_group(pdf, p, top)

    return merge


def pack(docs: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    p = params
    schema = CUT + ", ids array<int>" * keep_ids
    cut = staged(texts(docs, id_col, text_col).mapInPandas(lambda b: _cut_partition(b, p, keep_ids), schema), "cut")
    parts = (cut.agg(F.max(F.shiftright("key", 33)).alias("g")).head()["g"] or 0) + 1
    dealt = cut.repartition(parts, "key").sortWithinPartitions(F.xxhash64("key"), "key").drop("key")
    pieces = staged(dealt.mapInArrow(lambda b: _pack_partition(b, p), f"{schema.partition(', ')[2]}, {PLACE}"), "pieces")
    nearly = p.capacity - p.slack
    bins = pieces.where((F.col("bin_offset") == 0) & (F.col("bin_fill") < nearly)).select(
        "bin_id", F.col("bin_id").alias("cur"), F.lit(0).cast("long").alias("shift"), F.col("bin_fill").alias("fill"), "grp", F.lit(False).alias("final"))
    groups = (pieces.agg(F.max("grp").alias("g")).head()["g"] or 0) + 1
    placed: list[DataFrame] = []
    while True:
        left = bins.select("cur").distinct().count() if placed else bins.count()
        least = max(1, -(-left // p.group))
        groups, before = max(least, -(-groups // p.fan_in)), groups
        top = groups == 1 or groups == least or groups >= before
        dealt = bins.withColumn("grp", F.pmod(F.xxhash64("cur"), F.lit(groups)))
        merged = staged(dealt.groupBy("grp").applyInPandas(_merger(p, top), BINS), "bins")
        placed.append(merged.where("final").select("bin_id", "cur", "shift"))
        if top:
            break
        bins = merged.where("not final")
    moved = placed[0]
    for x in placed[1:]:
        moved = moved.unionByName(x)
    more = ["ids"] * keep_ids
    full = pieces.where(F.col("bin_fill") >= nearly).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin_id").alias("sequence_id"), F.col("bin_offset").alias("offset"), *more)
    rest = pieces.where(F.col("bin_fill") < nearly).join(moved, "bin_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("cur").alias("sequence_id"), (F.col("bin_offset") + F.col("shift")).alias("offset"), *more)
    return full.unionByName(rest)
