"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

1. Equal vectors become one representative with a count, so groups of copies cost nothing below. This is the only
   shuffle of all vectors; ids that repeat are found by ids alone.
2. A vector's sketch is the signs of its dot products with random hyperplanes. Each table's bucket is a few bits of
   it. Bits and tables follow from the number of vectors and the recall wanted at the threshold.
3. Only ids and sketches are dealt to the buckets. A bucket of any size is cut into blocks of ``block`` rows and
   every pair of blocks is one task's work, so nothing is capped. There, pairs whose sketches differ in more bits than
   a pair at the threshold is likely to are ruled out, and rows left without a pair drop out.
4. Vectors are attached to the rest, and every pair of a pair of blocks is decided by its exact cosine. A pair counts
   in the first table where it meets only. A task returns one row for each vector that has links: their
   number and the smallest id it is joined to there, not the pairs.
5. Those rows are the edges for connected components.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components link with
nothing and keep a row of their own; rows with a null id carry no identity and are left out; rows that
repeat an id are one vector (the smallest by array order); vectors of different lengths never link;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from weftlink.llm.common import join_hot, staged
from weftlink.llm.components import connected_components

#: Ids that are broadcast at most.
REPEATED = 100_000


@dataclass(frozen=True)
class VectorDedupParams:
    threshold: float = 0.95
    recall: float = 0.9995  #: probability that a pair at the threshold meets in some table
    bucket: int = 512  #: vectors in an even bucket, from which the number of bits follows
    block: int = 1024
    sketch: int = 256  #: signs by which pairs are ruled out before vectors are attached
    seed: int = 20

    def shape(self, n: int) -> tuple[int, int]:
        """(bits, tables) for n vectors."""
        bits = min(48, max(6, math.ceil(math.log2(max(1, n / self.bucket)))))
        met = (1 - math.acos(self.threshold) / math.pi) ** bits
        return bits, max(1, math.ceil(math.log((1 - self.recall) / 2) / math.log(1 - met)))

    def most_apart(self) -> int:
        """The least number of differing signs that a pair at the threshold exceeds with half of the lost recall at most."""
        m, p = self.sketch, math.acos(self.threshold) / math.pi
        log = lambda k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p)
        over, k = 0.0, m
        while k > 0 and over + math.exp(log(k)) <= (1 - self.recall) / 2:
            over += math.exp(log(k))
            k -= 1
        return k


def finite(vec: Column) -> Column:
    """True for vectors that have components, all of them finite numbers."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def one_per_id(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec), each id once: of rows that repeat an id the smallest vector. Components are float where they were, else double.

    Only ids are shuffled to find those that repeat. Up to ``REPEATED`` of them are broadcast, so that all other vectors
    stay where they are; beyond that vectors are shuffled by id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id IS NOT NULL")
    if not isinstance(rows.schema["vec"].dataType.elementType, FloatType):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    repeated = staged(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    n = repeated.count()
    if not n:
        return rows
    folded = lambda x: x.groupBy("id").agg(F.min("vec").alias("vec"))
    if n > REPEATED:
        return folded(rows)
    few = F.broadcast(repeated)
    return rows.join(few, "id", "left_anti").unionByName(folded(rows.join(few, "id", "left_semi")))


def _hasher(bits: int, tables: int, n_signs: int, seed: int):
    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            sketch, codes = np.empty(len(pdf), object), np.empty((len(pdf), tables), np.int64)
            dims = pdf["vec"].map(len).to_numpy()
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, n_signs))
                at = np.flatnonzero(dims == dim)
                x = np.stack(pdf["vec"].to_numpy()[at]).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                signs = x @ planes[dim] >= 0
                codes[at] = _codes(signs, tables, bits)
                sketch[at] = [row.tobytes() for row in np.packbits(signs, axis=1)]
            yield pdf.assign(sketch=sketch, codes=list(codes))

    return sketches


def _codes(signs: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket numbers of the first ``tables`` tables, whose signs are the first ones of the sketch."""
    return signs[:, : tables * bits].reshape(len(signs), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _signs(column: pd.Series) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1), axis=1)


def _first_meetings(signs: np.ndarray, a: np.ndarray, b: np.ndarray, t: int, bits: int) -> np.ndarray:
    """Whether pairs of rows share no bucket of a table before ``t``."""
    first = np.ones(len(a), bool)
    codes = _codes(signs, t, bits)
    for own in codes.T:
        first &= own[a] != own[b]
    return first


def _sieve(most_apart: int, n_signs: int, bits: int):
    def sieve(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of one pair of blocks that are in a pair whose sketches are near enough and that meets here first."""
        t, i, j = int(pdf["t"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        own = pdf["b"].to_numpy()
        signs = _signs(pdf["sketch"])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x = signs[:, :n_signs].astype(np.float32) * 2 - 1
        p, q = np.nonzero(x[left] @ x[right].T >= n_signs - 2 * most_apart)
        a, b = left[p], right[q]
        if i == j:
            once = a < b
            a, b = a[once], b[once]
        ok = _first_meetings(signs, a, b, t, bits)
        return pdf.iloc[np.unique(np.concatenate([a[ok], b[ok]]))].drop(columns="sketch")

    return sieve


def _linker(threshold: float, bits: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs of one pair of blocks: links of each row and the root of its local component."""
        t, i, j = int(pdf["t"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("rep", kind="stable")
        ids, mult, own = pdf["rep"].to_numpy(), pdf["mult"].to_numpy(), pdf["b"].to_numpy()
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        cos = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None, :]
        p, q = np.nonzero(cos >= threshold - 1e-9)
        a, b = left[p], right[q]
        ok = a < b if i == j else np.ones(len(a), bool)
        ok &= _first_meetings(_signs(pdf["sketch"]), a, b, t, bits)  # a pair that met before counted there
        a, b = a[ok], b[ok]
        near = np.abs(cos[p[ok], q[ok]] - threshold) < 1e-9
        if near.any():
            exact = np.einsum("ij,ij->i", x[a[near]], x[b[near]]) / (norm[a[near]] * norm[b[near]])
            keep = np.ones(len(a), bool)
            keep[np.flatnonzero(near)[exact < threshold]] = False
            a, b = a[keep], b[keep]
        links = np.bincount(a, mult[b], len(ids)) + np.bincount(b, mult[a], len(ids))
        root = np.arange(len(ids))
        while True:  # smallest label of each local component
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        has = np.flatnonzero(links)
        return pd.DataFrame({"rep": ids[has], "links": links[has].astype(np.int64), "root": ids[root[has]]})

    return link


def dedup_vectors(vectors: DataFrame, params: VectorDedupParams = VectorDedupParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per id: vec_id, n_links, component_id (smallest id reachable), kept (vec_id = component_id)."""
    p = params
    rows = staged(one_per_id(vectors, id_col, vec_col), "vectors")
    usable = finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    good = rows.where(usable)
    n = good.count()
    bits, tables = p.shape(n)
    n_signs = 8 * math.ceil(max(p.sketch, tables * bits) / 8)
    reps = good.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    of = reps.schema["vec"].dataType.simpleString()
    coded = staged(reps.mapInPandas(_hasher(bits, tables, n_signs, p.seed), f"vec {of}, rep long, mult long, sketch binary, codes array<long>"), "sketches")
    reps = coded.select("vec", "rep", "mult")
    buckets = coded.select(F.size("vec").alias("dim"), "rep", "sketch", F.posexplode("codes").alias("t", "code"))
    key = ["t", "code", "dim"]
    shared = buckets.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / p.block).cast("int"))
    placed = join_hot(buckets, shared, key, n * tables).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(*key, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "sketch")
    where = [*key, "i", "j"]
    left = staged(paired.groupBy(*where).applyInPandas(_sieve(p.most_apart(), p.sketch, bits), "t int, code long, dim int, i int, j int, b int, rep long"), "vector-candidates")
    found = staged(left.join(coded.drop("codes"), "rep").groupBy(*where).applyInPandas(_linker(p.threshold, bits), "rep long, links long, root long"), "vector-links")
    n_links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "rep", "root").select(F.col("id").alias("rep"), "component")
    nodes = reps.join(n_links, "rep", "left").join(comps, "rep", "left").select(
        "rep", "vec", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = nodes.where("mult = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    copies = join_hot(good, nodes.where("mult > 1"), ["vec"], n, "mult").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = rows.where(~usable).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return alone.unionByName(copies).unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
