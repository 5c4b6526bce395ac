"""Duplicate consolidation and recurrence across brains, by connected components of similarity edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.similarity import similar_classes, token_set
from lodestone.plans.components import connected_components
from lodestone.session import stash

CONSOLIDATE, RECUR_COSINE, RECUR_JACCARD = 0.9, 0.9, 0.3
#: Classes of a block at most, and those that are worth a block of their own; pairs whose cosine is summed at a time where rounding could decide.
BLOCK_CLASSES, SMALL_BLOCK, FEW_PAIRS = 8192, 512, 65_536
#: Rows of a block that meet the other one at a time, and the share of pairs that hold a word from which on it is a column of a matrix.
TILE, DENSE = 256, 0.005


def survivor_order() -> list[Column]:
    verified = F.when(F.col("kind") == "memory", F.coalesce("verified", F.lit(""))).otherwise("")
    return [verified.desc(), F.col("created").desc(), F.col("id")]


def consolidation_clusters(notes: DataFrame, threshold: float = CONSOLIDATE) -> DataFrame:
    """(id, component) of live notes of one kind that are similar, directly or through others."""
    live = notes.filter("coalesce(status, '') <> 'superseded'")
    sets = live.select("id", "kind", token_set(F.concat_ws(" ", "title", "body")).alias("tokens"))
    found = connected_components(similar_classes(sets, threshold, ["kind"]).select("a", "b"))
    return found.withColumnRenamed("node", "id")


def consolidation_plan(notes: DataFrame, threshold: float = CONSOLIDATE) -> DataFrame:
    """(duplicate, survivor): every member of a cluster but its survivor, in id order."""
    members = notes.join(consolidation_clusters(notes, threshold), "id")
    first = Window.partitionBy("component").orderBy(*survivor_order())
    placed = members.select("id", "component", F.row_number().over(first).alias("place"), F.first("id").over(first).alias("survivor"))
    return placed.filter("place > 1").select(F.col("id").alias("duplicate"), "survivor")


def is_graduatable(allow_decisions: bool = False) -> Column:
    memory = (F.col("kind") == "memory") & (F.col("status") == "active")
    decision = (F.col("kind") == "decision") & (F.col("status") == "accepted") & F.lit(allow_decisions)
    return F.coalesce(F.col("graduate"), F.lit(False)) & (memory | decision)


class _Side:
    """Classes of one block, by size: names, brains, vectors and words, as arrays."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values("n", kind="stable")
        self.node, self.brain, self.n = rows["node"].to_numpy(), rows["brain"].to_numpy(), rows["n"].to_numpy(np.float64)
        self.row = np.repeat(np.arange(len(rows)), rows["n"].to_numpy(np.int64))
        self.words = np.concatenate(rows["words"].tolist()) if len(rows) else np.zeros(0, np.int64)
        self.dims = np.array([len(v) for v in rows["vec"]], np.int64)
        self.vec = np.zeros((len(rows), width))
        for i, v in enumerate(rows["vec"]):
            self.vec[i, : len(v)] = v
        total = np.zeros(len(rows))
        for c in self.vec.T:
            total += c * c
        self.length = np.sqrt(total)


def _words(a: _Side, b: _Side) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
    """Matrices of the words that a good share of pairs has in common, one a side, and the others: rows and words of a; where each word's rows of b begin, and these."""
    both, at = np.unique(np.concatenate([a.words, b.words]), return_inverse=True)
    at_a, at_b = at[: len(a.words)], at[len(a.words) :]
    n_a, n_b = np.bincount(at_a, minlength=len(both)), np.bincount(at_b, minlength=len(both))
    dense = n_a * n_b >= max(1, DENSE * len(a.n) * len(b.n))
    column = np.cumsum(dense) - 1
    sides = []
    for side, where in ((a, at_a), (b, at_b)):
        m = np.zeros((len(side.n), int(dense.sum())), np.float32)
        held = dense[where]
        m[side.row[held], column[where[held]]] = 1
        sides.append(m)
    few_a, few_b = ~dense[at_a] & (n_b[at_a] > 0), ~dense[at_b]
    order = np.argsort(at_b[few_b], kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.where(dense, 0, n_b))])
    return (sides[0], sides[1]), [a.row[few_a], at_a[few_a], begin, b.row[few_b][order]]


def _near(a: _Side, b: _Side, rows: slice, columns: slice, asked: np.ndarray, least: float) -> np.ndarray:
    """Which of the asked pairs have a cosine of at least that. What rounding could decide is summed component by component, as `cosine` does."""
    x, y, long = a.vec[rows], b.vec[columns], (a.length[rows], b.length[columns])
    known = (a.dims[rows][:, None] == b.dims[columns]) & (long[0] > 0)[:, None] & (long[1] > 0)
    units = [m / np.where(s > 0, s, 1)[:, None] for m, s in zip((x, y), long, strict=True)]
    score = np.where(known, units[0] @ units[1].T, 0.0)
    near = score >= least
    i, j = np.nonzero(asked & known & (np.abs(score - least) < 1e-9))
    for start in range(0, len(i), FEW_PAIRS or 1):
        p, q = i[start : start + (FEW_PAIRS or 1)], j[start : start + (FEW_PAIRS or 1)]
        dot = np.zeros(len(p))
        for c, d in zip(x.T, y.T, strict=True):
            dot += c[p] * d[q]
        near[p, q] = dot / (long[0][p] * long[1][q]) >= least
    return near & asked


def _links(a: _Side, b: _Side, cosine_least: float, jaccard_least: float) -> np.ndarray:
    """Which classes of one side are linked with which of the other; of a block and itself, each pair at least one way."""
    linked = np.zeros((len(a.n), len(b.n)), bool)
    (dense_a, dense_b), (few_row, few_word, begin, few_b) = _words(a, b)
    for start in range(0, len(a.n), TILE):
        end = min(start + TILE, len(a.n))
        # sets of other sizes have too little in common
        left = start if a is b else int(np.searchsorted(b.n, jaccard_least * a.n[start] - 1e-6))
        right = int(np.searchsorted(b.n, a.n[end - 1] / jaccard_least + 1e-6, side="right")) if jaccard_least > 0 else len(b.n)
        if left >= right:
            continue
        # counts below 2^24 are exact in single precision
        both = dense_a[start:end] @ dense_b[left:right].T
        p, q = np.searchsorted(few_row, (start, end))
        word = few_word[p:q]
        times = begin[word + 1] - begin[word]
        total = int(times.sum())
        if total:
            other = few_b[np.repeat(begin[word] - np.cumsum(times) + times, times) + np.arange(total)]
            cell = np.repeat(few_row[p:q] - start, times) * (right - left) + other - left
            held = (other >= left) & (other < right)
            both += np.bincount(cell[held], minlength=both.size).reshape(both.shape)
        sizes = (a.n[start:end].astype(np.float32)[:, None], b.n[left:right].astype(np.float32))
        asked = both * (1 + jaccard_least) >= jaccard_least * (sizes[0] + sizes[1]) * (1 - 1e-5)
        i, j = np.nonzero(asked & (a.brain[start:end][:, None] != b.brain[left:right]))
        common = both[i, j].astype(np.float64)
        fine = common / (a.n[start + i] + b.n[left + j] - common) >= jaccard_least
        asked = np.zeros(both.shape, bool)
        asked[i[fine], j[fine]] = True
        if fine.any():
            linked[start:end, left:right] = _near(a, b, slice(start, end), slice(left, right), asked, cosine_least)
    return linked


def _spanning(cosine_least: float, jaccard_least: float):
    """Edges that join what the links between two blocks join: a forest, so n classes give fewer than n rows however many links they have."""

    def f(key: tuple, unit: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        out_a, out_b = [], []
        if (unit["block"] == i).any() and (unit["block"] == j).any():
            width = max(len(v) for v in unit["vec"])
            a = _Side(unit[unit["block"] == i], width)
            b = a if i == j else _Side(unit[unit["block"] == j], width)
            linked = _links(a, b, cosine_least, jaccard_least)
            nodes = (a.node, b.node)
            unseen = (np.ones(len(a.n), bool), np.ones(len(b.n), bool))
            # rows without a link reach nothing
            for root in np.flatnonzero(linked.any(axis=1)).tolist():
                if not unseen[0][root]:
                    continue
                unseen[0][root], reached = False, [(0, root)]
                while reached:
                    side, at = reached.pop()
                    new = np.flatnonzero((linked[at] if side == 0 else linked[:, at]) & unseen[1 - side])
                    unseen[1 - side][new] = False
                    out_a += [nodes[side][at]] * len(new)
                    out_b += nodes[1 - side][new].tolist()
                    reached += [(1 - side, k) for k in new.tolist()]
        return pd.DataFrame({"a": out_a, "b": out_b}, dtype=object)

    return f


def _digests(classes: DataFrame) -> DataFrame:
    """`tokens` as `words`, digests that tell all words of the classes apart: with another seed, should two of them have the same."""
    vocabulary, seed = classes.select(F.explode("tokens").alias("token")), F.lit(0)
    while vocabulary.groupBy(F.xxhash64(seed, "token").alias("d")).agg(F.min("token").alias("x"), F.max("token").alias("y")).filter("x <> y").take(1):
        seed = seed + 1
    return classes.withColumn("n", F.size("tokens")).withColumn("words", F.transform("tokens", lambda w: F.xxhash64(seed, w))).drop("tokens")


def _blocks(sizes: list, jaccard_least: float) -> tuple[list[tuple], list[tuple]]:
    """Blocks of (kind, n, classes) of classes of near sizes -> (kind, n, first, parts), where classes of a size are dealt to so many blocks from the first one on, and (kind, block, i, j) of the pairs of blocks that can hold links."""
    places, units = [], []
    for kind in sorted({s[0] for s in sizes}):
        of_kind = sorted((n, m) for k, n, m in sizes if k == kind)
        most = min(BLOCK_CLASSES, max(SMALL_BLOCK, -(-sum(m for _, m in of_kind) // 12)))
        ranges: list[list[int]] = []
        held = 0
        for n, m in of_kind:
            parts = -(-m // most)
            if not ranges or held + m > most:
                ranges += [[n, n] for _ in range(parts)]
                # a size that fills several blocks shares none of them
                held = m if parts == 1 else most
                places.append((kind, n, len(ranges) - parts, parts))
            else:
                ranges[-1][1] = n
                held += m
                places.append((kind, n, len(ranges) - 1, 1))
        for i, (_, high) in enumerate(ranges):
            for j in range(i, len(ranges)):
                if high >= jaccard_least * ranges[j][0] - 1e-6:
                    units += [(kind, k, i, j) for k in {i, j}]
    return places, units


def _class_links(classes: DataFrame, cosine_least: float, jaccard_least: float) -> DataFrame:
    """(a, b) that join the classes (kind, brain, vec, tokens, node) which links join.

    At a threshold as low as this nearly all pairs have a word in common, so each pair of blocks of a kind is a unit. Blocks
    hold classes of near sizes, and those whose sizes allow no link don't meet. Overlaps are matrix products for the words that
    many hold and counts of pairs for all others; a class is copied once a block, and no pair leaves its unit but in a forest.
    """
    spark = classes.sparkSession
    sizes = [(r["kind"], r["n"], r["m"]) for r in classes.groupBy("kind", F.size("tokens").alias("n")).agg(F.count("*").alias("m")).collect()]
    places, units = _blocks(sizes, jaccard_least)
    place = spark.createDataFrame(places, "kind string, n int, first int, parts int")
    unit = spark.createDataFrame(units, "kind string, block int, i int, j int")
    block = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    dealt = _digests(classes).join(F.broadcast(place), ["kind", "n"]).withColumn("block", block).join(F.broadcast(unit), ["kind", "block"])
    return dealt.select("kind", "i", "j", "block", "node", "brain", "vec", "n", "words").groupBy("kind", "i", "j").applyInPandas(_spanning(cosine_least, jaccard_least), "a string, b string")


def recurrence_clusters(notes: DataFrame, vectors: DataFrame, cosine_least: float = RECUR_COSINE, jaccard_least: float = RECUR_JACCARD, allow_decisions: bool = False) -> DataFrame:
    """(id, component) of eligible notes that recur in at least two brains. Notes without a vector of finite numbers drop.

    Pairs of one kind and different brains must be similar in both measures. Notes of equal kind, words, brain and vector
    are one class, which has the same links as each of them and none within itself, so copies add a row each and no pairs.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    eligible = notes.filter(is_graduatable(allow_decisions) & F.col("brain").isNotNull())
    pool = eligible.join(vectors.filter(finite), "id").select("id", "kind", "brain", "vec", token_set(F.concat_ws(" ", "title", "body")).alias("tokens"))
    keyed = stash(pool, "recurrence-pool").filter(F.size("tokens") > 0).withColumn("set_key", F.unhex(F.sha2(F.array_join(F.sort_array("tokens"), " ").cast("binary"), 256)))
    key = ["kind", "set_key", "brain", "vec"]
    members = keyed.select("id", *key)
    classes = stash(keyed.groupBy(*key).agg(F.min("id").alias("node"), F.first("tokens").alias("tokens")), "recurrence-classes")
    links = _class_links(classes, cosine_least, jaccard_least)
    found = connected_components(links)
    placed = members.join(classes, key).join(found, "node").select("id", "brain", "component")
    spread = placed.groupBy("component").agg(F.countDistinct("brain").alias("brains")).filter("brains >= 2")
    return placed.join(spread.select("component"), "component").select("id", "component").distinct()


def cluster_key(refs: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(refs)), "\n").cast("binary"), 256), 1, 16)


def graduation_candidates(notes: DataFrame, clusters: DataFrame) -> DataFrame:
    """One candidate a cluster: its representative's kind and title, and sorted references to all members."""
    members = notes.join(clusters, "id").withColumn("ref", F.concat_ws("/", F.coalesce(F.nullif("source", F.lit("")), F.col("brain")), "id"))
    best = members.groupBy("component").agg(
        F.min_by(F.struct("kind", "title", "id"), F.struct(F.when(F.col("kind") == "memory", F.col("verified").isNull()).otherwise(True), F.datediff(F.lit("2999-01-01"), F.when(F.col("kind") == "memory", F.col("verified"))), F.datediff(F.lit("2999-01-01"), "created"), "id")).alias("rep"),
        F.array_sort(F.collect_set("ref")).alias("refs"), F.countDistinct("brain").alias("brains"),
    )
    return best.select(cluster_key(F.col("refs")).alias("cluster_key"), "rep.kind", "rep.title", F.col("rep.id").alias("representative"), F.array_join("refs", ",").alias("refs"), "brains")


def suppress(candidates: DataFrame, tombstones: DataFrame, include_rejected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates whose cluster no reviewer rejected, and the number that were suppressed."""
    if include_rejected:
        return candidates, candidates.filter("false").agg(F.count("*").alias("suppressed"))
    return candidates.join(tombstones, "cluster_key", "left_anti"), candidates.join(tombstones, "cluster_key", "left_semi").agg(F.count("*").alias("suppressed"))
