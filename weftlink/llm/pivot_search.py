"""Exact top-k inner products through a pivot-distance index.

Candidates are lifted to one norm M (one more component, sqrt(M^2 - |x|^2); queries get 0 there), so
that larger inner products are smaller distances: |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. Every
candidate is keyed by its nearest pivot and its distance r from it. Around each pivot the candidates
form annuli, cut at quantiles of r, and by the triangle inequality an annulus [r1, r2] holds
nothing nearer to q' than max(r1 - d(q', p), d(q', p) - r2).

1. Each query searches its most promising annulus, which gives a k-th best score.
2. It then goes to those other annuli whose bound that score doesn't rule out, and inside each of them
   expands thin sorted rings outward from its own distance, stopping where the bound rules out the rest.

Pivots are fitted on a bounded sample (it changes the work, never the result), and their number and that of
the annuli is bounded, so the index's description is small; large annuli are cut into blocks, and so are the queries.
Scores are integer inner products, exact as long as they stay below 2^53.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as rows
with a null id; rows that repeat an id are one vector (the smallest by array order); a query is compared with
vectors of its own length, each length in an index of its own; ties go to the smaller id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftlink.llm.common import staged
from weftlink.llm.embedding_dedup import finite, one_per_id


@dataclass(frozen=True)
class SearchParams:
    k: int = 5
    sample: int = 4096  #: vectors that the pivots are fitted on
    pivots: int = 64  #: at most
    annuli: int = 64  #: at most, for each pivot
    block: int = 4096  #: candidates that one task compares with a block of queries
    queries: int = 2048  #: queries in a block
    ring: int = 512  #: candidates in a thin ring
    seed: int = 6


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, vec): floor(scale * x) of every component, for vectors that take part."""
    rows = one_per_id(vectors, id_col, vec_col).where(finite(F.col("vec")))
    # Spark's floor gives a long; from 2^52 on every double is whole already
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    return rows.select("id", F.transform("vec", lambda x: whole(x.cast("double") * F.lit(scale))).alias("vec"))


@dataclass(frozen=True)
class _Index:
    """The bounded description that tasks get."""

    pivots: np.ndarray  # (pivots, dim + 1)
    top: float  # M^2
    cells: np.ndarray  # (cells, 4): cell, pivot, r1, r2
    blocks: dict[int, int]
    params: SearchParams

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.top - np.einsum("ij,ij->i", x, x)))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        return _distances(lifted, self.pivots)

    def best_scores(self, sq: np.ndarray, d: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """Upper bound of a query's scores in an annulus; rounded up by far more than doubles err."""
        gap = np.maximum(0, np.maximum(r1 - d, d - r2))
        return (sq + self.top - gap * gap) / 2 + 1e-9 * (sq + self.top) + 1e-6


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, sq))


def _fit_pivots(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A few rounds of k-means from points far apart."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = _distances(x, x[chosen])[:, 0]
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    pivots = x[chosen]
    for _ in range(5):
        near = _distances(x, pivots).argmin(1)
        pivots = np.stack([x[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _keyer(pivots: np.ndarray, top: float):
    index = _Index(pivots, top, np.empty((0, 4)), {}, SearchParams())

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = index.distances(index.lifted(_stack(pdf["vec"])))
                near = d.argmin(1)
                yield pdf.assign(pivot=near.astype("int32"), r=d[np.arange(len(d)), near])

    return key


def _query_bounds(index: _Index, vec: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of queries' scores by annulus, and the queries' distances from the annuli's pivots."""
    q, cells = _stack(vec), index.cells
    sq = np.einsum("ij,ij->i", q, q)
    d = index.distances(np.column_stack([q, np.zeros(len(q))]))[:, cells[:, 1].astype(int)]
    return index.best_scores(sq[:, None], d, cells[None, :, 2], cells[None, :, 3]), d


def _homes(index: _Index):
    """Adds to each query the annulus that it searches first, as a position in ``index.cells``."""

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                bound, d = _query_bounds(index, pdf["vec"])
                best = np.lexsort((np.broadcast_to(index.cells[:, 0], d.shape), d, -bound), axis=1)[:, 0]
                yield pdf.assign(home=best.astype("int32"))

    return home


def _router(index: _Index, first: bool, parts: int):
    """Sends queries (query_id, vec, home, floor) to the blocks of the annuli that they have to search."""
    cells = index.cells

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            home = pdf["home"].to_numpy()
            if first:
                rows, cols = np.arange(len(pdf)), home
            else:
                open_ = _query_bounds(index, pdf["vec"])[0] >= pdf["floor"].to_numpy()[:, None]
                open_[np.arange(len(pdf)), home] = False  # searched before
                rows, cols = np.nonzero(open_)
            n = np.asarray([index.blocks[int(c)] for c in cells[cols, 0]], np.int64)
            at = np.repeat(np.arange(len(rows)), n)
            block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            out = pdf.iloc[rows[at]].reset_index(drop=True)
            yield out.drop(columns="home").assign(cell=cells[cols[at], 0].astype("int32"), block=block.astype("int32"), part=(out["query_id"] % parts).astype("int32"))

    return route


def _searcher(index: _Index):
    p = index.params

    def search(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(queries) or not len(found):
            return empty
        found = found.sort_values(["r", "id"], kind="stable")
        q, x, ids, r = _stack(queries["vec"]), _stack(found["vec"]), found["id"].to_numpy(), found["r"].to_numpy()
        qid, floor = queries["query_id"].to_numpy(), queries["floor"].to_numpy().copy()
        sq = np.einsum("ij,ij->i", q, q)
        d = index.distances(np.column_stack([q, np.zeros(len(q))]))[:, int(found["pivot"].iloc[0])]
        starts = np.arange(0, len(x), p.ring)
        ends = np.minimum(starts + p.ring, len(x))
        bounds = index.best_scores(sq[:, None], d[:, None], r[starts][None, :], r[ends - 1][None, :])
        rows, best, names = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for ring in np.argsort(-bounds.max(0), kind="stable"):  # outward
            active = np.flatnonzero(bounds[:, ring] >= floor)
            if not len(active):
                continue
            own = slice(starts[ring], ends[ring])
            scores = q[active] @ x[own].T
            hit = (scores >= floor[active][:, None]) & (ids[own][None, :] != qid[active][:, None])
            a, c = np.nonzero(hit)
            if not len(a):
                continue
            rows, best, names = np.concatenate([rows, active[a]]), np.concatenate([best, scores[a, c]]), np.concatenate([names, ids[own][c]])
            order = np.lexsort((names, -best, rows))
            rows, best, names = rows[order], best[order], names[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = rank < p.k
            last = rank == p.k - 1
            floor[rows[last]] = np.maximum(floor[rows[last]], best[last])
            rows, best, names = rows[kept], best[kept], names[kept]
        return pd.DataFrame({"query_id": qid[rows], "vec_id": names, "score": best.astype(np.int64)}) if len(rows) else empty

    return lambda queries, found: search(queries, found)


def top_k(candidates: DataFrame, is_query: str, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``candidates(id, vec)`` that satisfy ``is_query``, against all other rows of their length."""
    rows = staged(candidates, "search-vectors")
    found = candidates.sparkSession.createDataFrame([], SCHEMA)
    for r in rows.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect():
        found = found.unionByName(_top_k(rows.where(F.size("vec") == r["dim"]), r["dim"], is_query, params))
    return found


SCHEMA = "query_id long, rank int, vec_id long, score long"


def _top_k(rows: DataFrame, dim: int, is_query: str, p: SearchParams) -> DataFrame:
    """``top_k`` of vectors of one length."""
    schema, spark = SCHEMA, rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(p.sample).toPandas()
    n, top = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).head()
    n_queries = rows.where(is_query).count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    side = max(1, math.ceil(math.sqrt(n / p.block)))
    blank = _Index(np.empty((0, dim + 1)), top, np.empty((0, 4)), {}, p)
    pivots = _fit_pivots(blank.lifted(_stack(sample["vec"])), min(side, p.pivots), p.seed)
    keyed = staged(rows.mapInPandas(_keyer(pivots, top), "id long, vec array<double>, pivot int, r double"), "search-keys")
    annuli = min(side, p.annuli)
    cuts = {r["pivot"]: sorted(set(r["q"])) for r in keyed.groupBy("pivot").agg(F.percentile_approx("r", [i / annuli for i in range(1, annuli)] or [1.0], 1000).alias("q")).collect()}
    edges = F.array(*[F.array(*[F.lit(float(x)) for x in cuts.get(k, [])]).cast("array<double>") for k in range(len(pivots))])
    ring = F.size(F.filter(edges[F.col("pivot")], lambda c: c < F.col("r")))
    celled = keyed.withColumn("cell", F.col("pivot") * (annuli + 1) + ring)
    stats = celled.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("r").alias("r1"), F.max("r").alias("r2"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    cells = np.asarray([[s["cell"], s["pivot"], s["r1"], s["r2"]] for s in stats], np.float64)
    index = _Index(pivots, top, cells, {s["cell"]: -(-s["n"] // p.block) for s in stats}, p)
    parts = -(-n_queries // p.queries)
    blocks = F.create_map(*[F.lit(x) for c, b in index.blocks.items() for x in (c, b)])
    held = celled.withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("cell")]).cast("int"))
    found_schema = "query_id long, vec_id long, score long"
    routed = "query_id long, vec array<double>, floor double, cell int, block int, part int"
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def scan(queries: DataFrame, first: bool) -> DataFrame:
        """Candidates go only to the parts of the queries that have to search their block."""
        key = ["cell", "block", "part"]
        sent = queries.mapInPandas(_router(index, first, parts), routed)
        wanted = sent.groupBy("cell", "block").agg(F.collect_set("part").alias("parts"))  # as many as parts at most
        met = held.join(wanted, ["cell", "block"]).withColumn("part", F.explode("parts")).drop("parts")
        return sent.groupBy(*key).cogroup(met.groupBy(*key)).applyInPandas(_searcher(index), found_schema)

    queries = keyed.where(is_query).select(F.col("id").alias("query_id"), "vec")
    queries = staged(queries.mapInPandas(_homes(index), "query_id long, vec array<double>, home int"), "search-queries")
    start = scan(queries.withColumn("floor", F.lit(-math.inf)), True)
    start = staged(start.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k), "search-first")
    floors = start.where(F.col("rank") == p.k).select("query_id", F.col("score").cast("double").alias("found"))
    rest = scan(queries.join(floors, "query_id", "left").select("query_id", "vec", "home", F.coalesce("found", F.lit(-math.inf)).alias("floor")), False)
    both = start.drop("rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
