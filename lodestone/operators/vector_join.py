"""Exact vector neighbours with pivots: cells that the triangle inequality rules out are never met.

Vectors of length one are dealt to the nearest of some pivots and, within such a cell, to rings by their distance from it. What
a query can be near to in a ring is bounded by its own distance from the pivot. A first round meets the most promising rings
of each query and gives it a k-th score; a second one meets the other rings that could hold anything as near as that. Within
a unit, distances are one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import ship_package, stash

#: Pivots at most; fewer are taken of fewer vectors. Rings of a cell are so wide, so there are no more than 2 / RING + 1 of them.
PIVOTS, RING = 1024, 0.05
#: Vectors of each side in a unit.
BLOCK_QUERIES, BLOCK_VECTORS = 1024, 4096
#: Queries whose rings a task holds at a time.
ROUTED = 64
#: What rounding may change in a distance or a score.
_SLACK = 1e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy())
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ pivots.T)))


def _deal(pivots: np.ndarray):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                d = _distances(_unit(rows["vec"]), pivots)
                cell = d.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), r=d[np.arange(len(rows)), cell], ring=(d[np.arange(len(rows)), cell] / RING).astype(np.int32))

    return f


def _parts(counts: np.ndarray) -> np.ndarray:
    """The part of each ring: following rings of BLOCK_VECTORS vectors at most in sum, or one larger ring."""
    parts, part, room = [], -1, 0
    for n in counts:
        if n > room:
            part, room = part + 1, BLOCK_VECTORS
        room -= n
        parts.append(part)
    return np.array(parts, np.int64)


def _route(pivots: np.ndarray, rings: np.ndarray, parts: np.ndarray, k: int, first: bool):
    """Rings (places in the table of rings, a list a part) that a query meets: in the first round the nearest ones with k vectors in sum, else all others within its bound."""
    cells, nearest, farthest, counts = rings[:, 0].astype(np.int64), rings[:, 2], rings[:, 3], rings[:, 4]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            d = _distances(_unit(rows["vec"]), pivots) if len(rows) else np.empty((0, len(pivots)))
            for start in range(0, len(rows), ROUTED):
                out_row, out_part, out_rings = [], [], []
                for i in range(start, min(start + ROUTED, len(rows))):
                    from_pivot = d[i][cells]
                    least = np.maximum(np.maximum(from_pivot - farthest, nearest - from_pivot), 0.0)
                    # a vector lies nearer to its own pivot than to the query's nearest one
                    least = np.maximum(least, (from_pivot - d[i].min()) / 2)
                    order = np.argsort(least, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(counts[order]), k)) + 1
                    score = rows["least"].iloc[i]
                    within = least[order] <= math.sqrt(max(0.0, 2.0 - 2.0 * score)) + _SLACK
                    chosen = np.sort(order[:enough][within[:enough]] if first else order[enough:][within[enough:]]).astype(np.int32)
                    for part, at in zip(*_runs(parts[chosen], chosen), strict=True):
                        out_row.append(i)
                        out_part.append(part)
                        out_rings.append(at)
                met = rows.iloc[out_row]
                yield pd.DataFrame({"candidate": met["candidate"].to_numpy(), "vec": met["vec"].to_numpy(), "least": met["least"].to_numpy(), "part": np.array(out_part, np.int32), "rings": pd.Series(out_rings, dtype=object)})

    return f


def _runs(parts: np.ndarray, rings: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rings in order, cut where their part changes."""
    if not len(rings):
        return [], []
    cuts = np.flatnonzero(np.diff(parts)) + 1
    return parts[np.concatenate([[0], cuts])].tolist(), np.split(rings, cuts)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In the order of summation that the column expression has, so that both give the same double."""
    dot = aa = bb = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (math.sqrt(aa) * math.sqrt(bb))


def _compare(k: int):
    def f(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(vectors):
            scores = _unit(queries["vec"]) @ _unit(vectors["vec"]).T
            rings, of_vector = np.unique(vectors["at"].to_numpy(), return_inverse=True)
            met = np.stack([np.isin(rings, r) for r in queries["rings"]])
            scores = np.where(met[:, of_vector], scores, -np.inf)
            least = np.maximum(queries["least"].to_numpy(), 0.0)
            if scores.shape[1] > k:
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            for i, j in zip(*np.nonzero(scores >= least[:, None] - _SLACK), strict=True):
                found.append((queries["candidate"].iloc[i], vectors["head"].iloc[j], _cosine(queries["vec"].iloc[i], vectors["vec"].iloc[j])))
        return pd.DataFrame(found, columns=["candidate", "head", "score"])

    return f


def _usable(rows: DataFrame) -> DataFrame:
    """Vectors with a direction: not null, not empty, finite throughout, not zero."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("id", F.col("vec").cast("array<double>").alias("vec")).filter(F.coalesce(finite & (F.size("vec") > 0), F.lit(False)) & F.exists("vec", lambda x: x != 0))


def _key(vec: Column) -> Column:
    return F.unhex(F.sha2(vec.cast("string").cast("binary"), 256))


class Cells:
    """Existing vectors of one length in cells: heads (head, vec, at, part, sub), one a distinct vector; members (head, id); pivots; rings (cell, ring, nearest, farthest, vectors, subs)."""

    def __init__(self, canon: DataFrame, dim: int, pivots: int) -> None:
        ship_package(canon.sparkSession)
        rows = stash(_usable(canon).filter(F.size("vec") == dim).withColumn("head", _key(F.col("vec"))), "vectors-rows")
        self.members = rows.select("head", "id")
        heads = stash(rows.groupBy("head").agg(F.first("vec").alias("vec")), "vectors-heads")
        n = heads.count()
        self.dim, self.empty = dim, n == 0
        if self.empty:
            return
        # keys are digests, so the first of them are a fair and repeatable choice; their number is bounded
        chosen = heads.orderBy("head").limit(min(pivots, math.isqrt(n) + 1)).toPandas()
        self.pivots = _unit(chosen["vec"])
        dealt = stash(heads.mapInPandas(_deal(self.pivots), "head binary, vec array<double>, cell int, r double, ring int"), "vectors-dealt")
        rings = dealt.groupBy("cell", "ring").agg(F.min("r").alias("nearest"), F.max("r").alias("farthest"), F.count("*").alias("n")).orderBy("cell", "ring").toPandas()
        self.rings = rings.to_numpy(np.float64)
        subs = np.ceil(self.rings[:, 4] / BLOCK_VECTORS).astype(np.int64)
        places = canon.sparkSession.createDataFrame([(int(r[0]), int(r[1]), i, int(s)) for i, (r, s) in enumerate(zip(self.rings, subs, strict=True))], "cell int, ring int, at int, subs long")
        self.parts = _parts(self.rings[:, 4])
        parts = canon.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(self.parts)], "at int, part int")
        places = places.join(F.broadcast(parts), "at")
        # as many rows as rings of all cells, which are bounded
        self.places = F.broadcast(places)
        self.heads = dealt.join(self.places, ["cell", "ring"]).select("head", "vec", "at", "part", F.pmod(F.xxhash64("head"), F.col("subs")).alias("sub"))

    def _meet(self, queries: DataFrame, k: int, first: bool, blocks: int) -> tuple[DataFrame, DataFrame]:
        """(candidate, head, score) of what one round finds, and (candidate, at) of the rings met."""
        kind = queries.schema["candidate"].dataType.simpleString()
        route = _route(self.pivots, self.rings, self.parts, k, first)
        met = stash(queries.mapInPandas(route, f"candidate {kind}, vec array<double>, least double, part int, rings array<int>"), "vectors-met")
        block = F.pmod(F.xxhash64("candidate"), F.lit(blocks)).alias("block")
        subs = F.broadcast(self.places.groupBy("part").agg(F.max("subs").alias("subs")))
        sides = met.join(subs, "part").select("candidate", "vec", "least", "part", "rings", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"))
        units = met.select("part", block).distinct()
        vectors = self.heads.join(units, "part")
        keys = ["part", "sub", "block"]
        found = sides.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(_compare(k), f"candidate {kind}, head binary, score double")
        return stash(found, "vectors-found"), met.select("candidate", F.explode("rings").alias("at"))


def neighbours(candidates: DataFrame, canon: DataFrame, k: int, threshold: float = 0.0, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(candidate, rank, neighbour, score) of the k nearest canon vectors of each candidate, and (candidate, met, rings, vectors_met, vectors) of what was met for it.

    Nearness is the cosine, which must be positive and at least `threshold`; ties go to the smaller id, and a candidate is no
    neighbour of its own id. Equal vectors are one entry with members, of which the k + 1 first can count. Vectors that are
    null, empty, zero or not finite, and those of another length than the candidate's, take no part.
    """
    queries = stash(_usable(candidates).select(F.col("id").alias("candidate"), "vec", F.lit(float(threshold)).alias("least")), "vectors-queries")
    nothing = queries.select("candidate", F.lit(1).alias("rank"), F.col("candidate").alias("neighbour"), F.lit(0.0).alias("score")).limit(0)
    best, told = nothing, queries.select("candidate", *[F.lit(0).cast("long").alias(c) for c in ("met", "rings", "vectors_met", "vectors")]).limit(0)
    for dim in sorted(r[0] for r in queries.select(F.size("vec")).distinct().collect()):
        cells, own = Cells(canon, dim, pivots), queries.filter(F.size("vec") == dim)
        if cells.empty:
            continue
        blocks = -(-own.count() // BLOCK_QUERIES)
        # its own vector may be among the nearest: one more is kept
        one, rings_one = cells._meet(own, k + 1, True, blocks)
        kth = one.withColumn("place", F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("score")))).filter(F.col("place") <= k + 1)
        kth = kth.groupBy("candidate").agg(F.count("*").alias("m"), F.min("score").alias("lowest")).filter(F.col("m") == k + 1).select("candidate", "lowest")
        bounded = own.join(kth, "candidate", "left").select("candidate", "vec", F.greatest("least", F.coalesce("lowest", F.lit(0.0))).alias("least"))
        two, rings_two = cells._meet(bounded, k + 1, False, blocks)
        found = one.unionByName(two).filter((F.col("score") > 0) & (F.col("score") >= threshold))
        near = found.withColumn("place", F.rank().over(Window.partitionBy("candidate").orderBy(F.desc("score")))).filter(F.col("place") <= k + 1).drop("place")
        near = stash(near, "vectors-near")
        of_head = cells.members.join(near.select("head").distinct(), "head", "left_semi")
        of_head = of_head.withColumn("nth", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter(F.col("nth") <= k + 1).select("head", F.col("id").alias("neighbour"))
        rank = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("score"), "neighbour"))
        best = best.unionByName(near.join(of_head, "head").filter(F.col("candidate") != F.col("neighbour")).withColumn("rank", rank).filter(F.col("rank") <= k).select("candidate", "rank", "neighbour", "score"))
        sizes = candidates.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(cells.rings[:, 4])], "at int, n long")
        met = rings_one.unionByName(rings_two).join(F.broadcast(sizes), "at").groupBy("candidate").agg(F.count("*").alias("met"), F.sum("n").alias("vectors_met"))
        told = told.unionByName(met.select("candidate", "met", F.lit(len(cells.rings)).cast("long").alias("rings"), "vectors_met", F.lit(int(cells.rings[:, 4].sum())).alias("vectors")))
    return best, told
