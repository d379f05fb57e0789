"""Near-duplicate documents by ProbMinHash signatures, banding, exact verification and connected components.

1. Every row gets a key of its own and is written once. Its text becomes a fingerprint of its words, a signature of
   its shingles, and one hash per band.
2. Texts with the same words are one node, named by the smallest key.
3. In every band bucket of several nodes, the smallest is compared with all others: links as many as members,
   not as pairs. Their components are found.
4. Nodes of one bucket that are still in different components may link to each other though not to the
   smallest. Those outside the component of the bucket's smallest are compared with all of the bucket, in blocks
   bounded by rows and by bytes, each pair in the first band it shares, and exactly; a task returns one link for each
   node and other component, not the pairs. Buckets of the same members in several bands count once.
5. All comparisons take the shingles of whole texts. In step 3 a bucket's smallest is sent once for every ``salt``
   partners, so a hot one is spread. Joins on fingerprints, buckets, ids and components leave the rows of hot keys where they are.

Similarity is the probability Jaccard of the shingle weights: with weights "unit" that of the sets of
shingles, with "count" that of their counts.

Defined cases: a null text is an empty one; texts without words link with nothing; texts of fewer words
than a shingle have one shingle of them all; texts of any length are taken whole. ``dedup_documents`` decides by id: rows
that repeat an id are one document with several texts, which links by each of them and has one class; rows with a
null id link with nothing and have a null class. ``drop_near_duplicates`` decides by row: every text counts,
whatever its id, and no text goes unless a near copy of it stays. Extra columns are ignored or kept as they are; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import discard, fresh, is_empty, join_hot, staged, texts
from weftlink.llm.components import connected_components
from weftlink.llm.shingles import fingerprint, jaccard, mix, normal_bytes, shingle_sets, signatures


@dataclass(frozen=True)
class DedupParams:
    shingle: int = 5  #: words
    threshold: float = 0.8
    bands: int = 30
    rows: int = 5  #: signature components in a band: a pair at 0.8 shares no band with probability 7e-6
    weights: str = "unit"  #: or "count"
    salt: int = 256  #: partners that a bucket's smallest document is sent to at once
    block: int = 1024  #: rows of a bucket that one task compares with as many others, at most
    block_chars: int = 8_000_000  #: and characters of their texts, but for single longer texts
    batch_chars: int = 1_500_000
    seed: int = 1

    @property
    def components(self) -> int:
        return self.bands * self.rows

    @property
    def weighted(self) -> bool:
        return self.weights == "count"


_SKETCH = "key long, doc_id long, fp binary, n long, bands array<long>"


def _sketcher(p: DedupParams):
    """From (key, doc_id, text), in parts of so many characters."""
    steps = mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)

    def part(rows: pa.RecordBatch) -> pa.RecordBatch:
        blobs = [normal_bytes(t) for t in rows.column(2).to_pylist()]
        sets = shingle_sets(blobs, p.shingle)
        sig = signatures(sets, p.components, p.seed, p.weighted)
        bands = mix((sig.reshape(len(blobs), p.bands, p.rows) * steps).sum(2, dtype=np.uint64)).view(np.int64)
        ends = pa.array(np.arange(len(blobs) + 1, dtype=np.int32) * p.bands)
        columns = [rows.column(0), rows.column(1), pa.array([fingerprint(b) for b in blobs], pa.binary()), pa.array([len(x[0]) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1)))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "fp", "n", "bands"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray([len(t) for t in batch.column(2).to_pylist()])
            begin = held = 0
            for k, n in enumerate(size.tolist()):
                held += n
                if held >= p.batch_chars or k == len(size) - 1:
                    yield part(batch.slice(begin, k + 1 - begin))
                    begin, held = k + 1, 0

    return sketch


def _verifier(p: DedupParams):
    """Rows come sorted by (a, salt, role): the first document, then its partners."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first = None, None
        for pdf in batches:
            out, size, begin = [], 0, 0
            text = pdf["text"].tolist()
            heads = list(zip(pdf["a"].tolist(), pdf["salt"].tolist(), pdf["role"].tolist(), pdf["b"].tolist()))
            for k, t in enumerate(text):
                size += len(t)
                if size >= p.batch_chars or k == len(text) - 1:
                    sets = shingle_sets([normal_bytes(x) for x in text[begin:k + 1]], p.shingle)
                    for (a, salt, role, b), own in zip(heads[begin:k + 1], sets):
                        if role == 0:
                            key, first = (a, salt), own
                        elif key == (a, salt):
                            out.append((a, b, jaccard(first, own, p.weighted)))
                    begin, size = k + 1, 0
            yield pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return verify


def verify_pairs(pairs: DataFrame, text: DataFrame, p: DedupParams) -> DataFrame:
    """(a, b, similarity) of distinct pairs (a, b); ``text`` (rep, text) has one row for each document in them."""
    counts = staged(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    total = counts.agg(F.sum("n")).head()[0] or 0
    salts = F.ceil(F.col("n") / p.salt).cast("int")
    dealt = join_hot(pairs, counts, ["a"], total).select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    partner = dealt.join(text.withColumnRenamed("rep", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "text")
    first = counts.join(text.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    rows = first.unionByName(partner).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInPandas(_verifier(p), "a long, b long, similarity double")


def _shingler(p: DedupParams):
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at:at + 64]
                sets = shingle_sets([normal_bytes(t) for t in part["text"]], p.shingle)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "bands": part["bands"].to_numpy(), "sh": [h.tobytes() for h, _ in sets], "counts": [c.astype(np.int64).tobytes() if p.weighted else b"" for _, c in sets]})

    return shingles


def _linker(p: DedupParams):
    """Links between rows outside the bucket's main component (role 0) and all rows, of different components."""

    def read(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)) for h, c in zip(rows["sh"], rows["counts"])]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        small, large = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        out: list[tuple[int, int, float]] = []
        if len(small) and len(large):
            band = int(pdf["band"].iloc[0])
            ids, comps, bands, sets = large["rep"].to_numpy(), large["comp"].to_numpy(), np.stack(large["bands"].to_numpy()), read(large)
            sizes = np.asarray([len(h) for h, _ in sets])
            for rep, comp, own, x in zip(small["rep"].tolist(), small["comp"].tolist(), small["bands"], read(small)):
                n = len(x[0])
                met = (bands == own).argmax(1)  # they share this band, so the first that they share is never after it
                at = np.flatnonzero((met == band) & (comps != comp))
                if not p.weighted:
                    at = at[np.minimum(sizes[at], n) >= p.threshold * np.maximum(sizes[at], n)]
                if not len(at):
                    continue
                if p.weighted:
                    like = np.asarray([jaccard(x, sets[k], True) for k in at])
                else:
                    flat = np.concatenate([sets[k][0] for k in at])
                    found = x[0][np.minimum(np.searchsorted(x[0], flat), n - 1)] == flat
                    both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes[at]) - sizes[at])
                    like = both / (n + sizes[at] - both)
                best: dict[int, tuple[float, int]] = {}
                for k, j in zip(at[like >= p.threshold].tolist(), like[like >= p.threshold].tolist()):
                    if j > best.get(comps[k], (0.0, 0))[0]:
                        best[comps[k]] = (j, int(ids[k]))
                out += [(rep, other, j) for j, other in best.values()]
        return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return link


def _cross_links(shared: DataFrame, classes: DataFrame, nodes: DataFrame, text: DataFrame, total: int, p: DedupParams) -> DataFrame | None:
    """Links between components that meet in a bucket, or None if no two do. ``total`` is the number of rows of all buckets at least."""
    labelled = shared.join(classes, "rep", "left").select("band", "code", "rep", F.coalesce("comp", "rep").alias("comp"))
    own = F.xxhash64("rep")
    met = labelled.groupBy("band", "code").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "rep").alias("main"), F.count(F.lit(1)).alias("n"),
                                               F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 20)).alias("y")).where("lo < hi")
    # of buckets with the same members, that of the first band
    met = staged(met.groupBy("n", "x", "y", "main").agg(F.min(F.struct("band", "code")).alias("k")).select("k.band", "k.code", "main", "n"), "meeting")
    if is_empty(met):
        return None
    sized = text.select("rep", F.length("text").cast("long").alias("chars"))
    members = staged(join_hot(labelled, met, ["band", "code"], total).drop("n").join(sized, "rep"), "members")
    minor = F.col("comp") != F.col("main")
    blocks = lambda test: F.ceil(F.greatest(F.count(F.when(test, 1)) / p.block, F.coalesce(F.sum(F.when(test, F.col("chars"))), F.lit(0)) / p.block_chars)).cast("int")
    sizes = members.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n"), blocks(F.lit(True)).alias("n_all"), blocks(minor).alias("n_small"))
    needed = members.select("rep").distinct()
    sets = nodes.join(needed, "rep", "left_semi").join(text, "rep").select("rep", "bands", "text")
    sets = sets.mapInPandas(_shingler(p), "rep long, bands array<long>, sh binary, counts binary")
    rows = join_hot(members, sizes, ["band", "code"], total).join(sets, "rep")
    place = lambda count: F.pmod(F.xxhash64("rep"), count).cast("int")
    every = lambda count: F.sequence(F.lit(0), count - 1)
    n_all, n_small = F.col("n_all"), F.col("n_small")
    # one row for each pair of blocks that it takes part in, as any row (role 1) and, outside the main component, as one of the few (role 0)
    as_any = F.transform(every(n_small), lambda i: F.struct(F.lit(1).alias("role"), i.alias("i"), place(n_all).alias("j")))
    as_few = F.transform(every(n_all), lambda j: F.struct(F.lit(0).alias("role"), place(n_small).alias("i"), j.alias("j")))
    dealt = rows.withColumn("d", F.explode(F.when(minor, F.concat(as_any, as_few)).otherwise(as_any)))
    dealt = dealt.select("band", "code", "d.role", "d.i", "d.j", "rep", "comp", "bands", "sh", "counts")
    return staged(dealt.groupBy("band", "code", "i", "j").applyInPandas(_linker(p), "a long, b long, similarity double"), "cross-links")


def _components(links: DataFrame) -> DataFrame:
    return staged(connected_components(links).select(F.col("id").alias("rep"), F.col("component").alias("comp")), "classes")


def _links_by_id(sketches: DataFrame, groups: DataFrame, total: int) -> DataFrame | None:
    """Links between the nodes of ids that have several texts, or None if there are none."""
    ids = staged(sketches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-ids")
    if is_empty(ids):
        return None
    rows = join_hot(sketches.select("key", "doc_id", "fp", F.col("n").alias("size")), ids, ["doc_id"], total).drop("n")
    worded = join_hot(rows.where("size > 0"), groups.select("fp", "rep", "n"), ["fp"], total)
    members = staged(worded.select("doc_id", "rep").unionByName(rows.where("size = 0").select("doc_id", F.col("key").alias("rep"))), "texts-by-id")
    first = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    return staged(join_hot(members, first, ["doc_id"], total).where("a <> rep").select("a", F.col("rep").alias("b"), F.lit(1.0).alias("similarity")).distinct(), "links-by-id")


def row_classes(rows: DataFrame, p: DedupParams, by_id: bool) -> DataFrame:
    """(key, doc_id, n_shingles, comp, class_id) for every row of ``rows``, a written table of (key, doc_id, text) with distinct keys and no nulls.

    ``comp`` names the class by a key, ``class_id`` is the smallest doc_id in it. With ``by_id`` the texts of one doc_id are linked.
    """
    sketches = staged(rows.select("key", "doc_id", "text").mapInArrow(_sketcher(p), _SKETCH), "sketches")
    total = sketches.count()
    filled = sketches.where("n > 0")
    groups = staged(filled.groupBy("fp").agg(F.min("key").alias("rep"), F.min_by("doc_id", "key").alias("doc_id"), F.min("n").alias("size"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "groups")
    copies = staged(join_hot(filled.select("key", F.col("doc_id").alias("own"), "fp"), groups.where("n > 1"), ["fp"], total).where("key <> rep").select("key", F.col("own").alias("doc_id"), "rep", "size"), "copies")
    nodes = staged(filled.join(copies.select("key"), "key", "left_anti").select(F.col("key").alias("rep"), "bands"), "nodes")
    buckets = nodes.select("rep", F.posexplode("bands").alias("band", "code"))
    heads = staged(buckets.groupBy("band", "code").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    in_buckets = total * p.bands
    shared = staged(join_hot(buckets, heads, ["band", "code"], in_buckets).drop("n"), "buckets")
    text = staged(rows.select(F.col("key").alias("rep"), "text").join(shared.select("rep").distinct(), "rep", "left_semi"), "pair-texts")
    stars = shared.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = staged(verify_pairs(stars, text, p).where(F.col("similarity") >= p.threshold), "verified")
    classes = _components(links)
    more = _cross_links(shared, classes, nodes, text, in_buckets, p)
    named = _links_by_id(sketches, groups, total) if by_id else None
    added = [x for x in (more, named) if x is not None and not is_empty(x)]
    if added:
        for x in added:
            links = links.unionByName(x)
        classes = _components(links)
    discard(nodes, heads, shared, text)
    # class_id of every node: rows with the same words as one, rows without words each on its own
    alone = sketches.where("n = 0").select(F.col("key").alias("rep"), "doc_id", F.col("n").alias("size"), F.col("doc_id").alias("low"), F.lit(1).cast("long").alias("n"))
    every = groups.drop("fp").unionByName(alone)
    low = staged(classes.join(every.select("rep", "low"), "rep"), "linked-nodes")
    least = low.groupBy("comp").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("n"))
    linked = join_hot(low.select("rep", "comp"), least, ["comp"], total).select("rep", "comp", "class_id")
    every = staged(every.join(linked, "rep", "left").select("rep", "doc_id", "size", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("class_id", "low").alias("class_id")), "node-classes")
    own = every.select(F.col("rep").alias("key"), "doc_id", F.col("size").alias("n_shingles"), "comp", "class_id")
    others = join_hot(copies, every.where("n > 1").select("rep", "comp", "class_id", "n"), ["rep"], total)
    found = staged(own.unionByName(others.select("key", "doc_id", F.col("size").alias("n_shingles"), "comp", "class_id")), "row-classes")
    discard(sketches, groups, copies, low, every)
    return found


def dedup_documents(docs: DataFrame, params: DedupParams = DedupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), n_shingles (of the row's text), kept (doc_id = class_id)."""
    everything = texts(docs, id_col, text_col)
    rows = staged(everything.where("doc_id IS NOT NULL").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "rows")
    found = row_classes(rows, params, by_id=True).select("doc_id", "class_id", "n_shingles")
    discard(rows)
    nameless = everything.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("n_shingles"))
    return found.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, params: DedupParams = DedupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest id (null last), of several such rows the first in the table."""
    key = fresh(docs, "key")
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    last = F.lit((1 << 63) - 1)
    found = row_classes(rows.select(F.col(key).alias("key"), F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), params, by_id=False)
    first = found.where("doc_id = class_id")
    twice = first.groupBy("comp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = join_hot(first, twice, ["comp"], rows.count()).where("key <> least").select("key")
    gone = found.where("doc_id <> class_id").select("key").unionByName(again)
    return rows.join(gone.withColumnRenamed("key", key), key, "left_anti").select(*docs.columns)
