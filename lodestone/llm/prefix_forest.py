"""Approximate nearest neighbours by a forest of sorted hash prefixes.

Equal vectors are one row of the index. Each of TREES trees gives a row one long hash string: in rotated coordinates, the
signed coordinates of largest magnitude, a symbol each. Every tree is the whole table's strings in sorted order, dealt out as
runs of equal prefixes, so a subtree is a run or some whole runs.

1. Rows are counted by tree and first CELL_BITS bits, a table of fixed size.
2. A query descends every tree along its own string. All trees then ascend together, one bit at a time, until the subtrees
   over the query hold `enough` places. Where cells of CELL_BITS still hold more, each tree descends further in its own run.
3. A query visits the runs of its subtrees. A run ranks its rows for all its queries by eight-bit copies of the vectors.
4. What the trees found best is ranked again by the inner product of the original vectors in double precision. Rows
   that eight bits can't tell from the best ones are among these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import map_arrow, stash, task_number

#: Trees, rotations of a tree, symbols of a string; bits of a string, and of a symbol, at most.
TREES, ROTATIONS, SYMBOLS = 40, 3, 9
DEPTH, SYMBOL_BITS = 63, 8
#: Bits of the prefixes that are counted.
CELL_BITS = 14
#: Places that the trees of one query hold when they stop ascending, for each tree, as a power of the rows.
PLACES, POWER = 0.85, 0.55
#: Rows of a run, and queries that meet it at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Rows that meet in a task of the search, on average.
TASK_ROWS = 100_000
NEIGHBOURS = 20
#: Rows kept beyond the wanted number of neighbours, besides those that eight bits can't tell from the last of them.
SPARE = 4


def symbol_bits(n: int) -> int:
    """Bits of a symbol: n**POWER places in a tree are what is left of n rows after so many bits, and whole symbols tell rows apart best."""
    depth = (1 - POWER) * math.log2(max(n, 2))
    return max(1, round(depth / math.ceil(depth / SYMBOL_BITS)))


def _rotations(dim: int, tree: int, directions: int) -> np.ndarray:
    """(dim + 1, ROTATIONS * directions) directions of unit length, orthogonal where there is room."""
    drawn = np.random.default_rng([dim, tree]).standard_normal((ROTATIONS, max(dim + 1, directions), directions))
    turned = np.stack([np.linalg.qr(d)[0] for d in drawn])[:, : dim + 1]
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    return np.concatenate(list(turned), axis=1).astype(np.float32)


def hash_strings(vectors: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, rows): strings of symbols as numbers, the first symbol on top. The largest coordinates of all rotations come before second ones.

    Vectors have the length-levelling coordinate.
    """
    v, n, directions, symbols = vectors.astype(np.float32), len(vectors), 1 << bits - 1, min(SYMBOLS, DEPTH // bits)
    out = np.zeros((trees, n), np.int64)
    at = np.arange(n)
    for t in range(trees):
        turned = (v @ _rotations(vectors.shape[1] - 1, t, directions)).reshape(n, ROTATIONS, directions)
        size = np.abs(turned)
        for i in range(symbols):
            r = i % ROTATIONS
            largest = size[:, r].argmax(axis=1)
            out[t] = out[t] << bits | largest << 1 | (turned[at, r, largest] > 0)
            size[at, r, largest] = -1
    return out << DEPTH - symbols * bits


def levelled(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors in units of `longest` with one more coordinate that makes all lengths 1, so that the largest inner product has the smallest angle."""
    v = vectors / longest
    return np.column_stack([v, np.sqrt(np.maximum(1 - (v * v).sum(axis=1), 0))])


def enough(n: int, trees: int, least: int = 0, k: int = NEIGHBOURS) -> int:
    """Places that the trees of one query hold at least, so that one of them holds k rows besides the query's own.

    `least` rows, where rows fall into trees independently, take so many places.
    """
    rows = n * trees if least >= n else math.ceil(-n * math.log(1 - least / n))
    return min(n * trees, max(rows, trees * (k + 1), math.ceil(PLACES * trees * n**POWER)))


def ascended(cells: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """(queries,) the depth at which the trees together hold `wanted` places: cells (trees, queries), counts (trees, 2**CELL_BITS) as running sums with a leading 0."""
    depth = np.zeros(cells.shape[1], np.int64)
    todo = np.arange(cells.shape[1])
    for d in range(CELL_BITS, 0, -1):
        shift = CELL_BITS - d
        lo = cells[:, todo] >> shift << shift
        met = sum(counts[t][lo[t] + (1 << shift)] - counts[t][lo[t]] for t in range(len(counts))) >= wanted
        depth[todo[met]] = d
        todo = todo[~met]
        if not len(todo):
            break
    return depth


def _hash(trees: int, longest: float, dim: int, bits: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = task_number() << 33, 0
        for batch in batches:
            vectors = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            strings = np.ascontiguousarray(hash_strings(levelled(vectors, longest), trees, bits).T)
            n = len(vectors)
            # as a query, a vector is as long as the longest, whatever its own length, and has no further coordinate
            asked = np.flatnonzero(np.array(batch.column(4).to_pylist(), bool))
            of_query = [None] * n
            if len(asked):
                most = np.abs(vectors[asked]).max(axis=1, keepdims=True)
                turned = vectors[asked] / most
                turned = np.column_stack([turned / np.linalg.norm(turned, axis=1, keepdims=True), np.zeros(len(asked))])
                for i, s in zip(asked.tolist(), np.ascontiguousarray(hash_strings(turned, trees, bits).T), strict=True):
                    of_query[i] = s.tobytes()
            yield pa.record_batch([pa.array(range(part + at, part + at + n), pa.int64()), *[batch.column(i) for i in range(5)], pa.array([s.tobytes() for s in strings], pa.binary()), pa.array(of_query, pa.binary())], names=["row", "v", "h1", "h2", "ids", "asked", "strings", "as_query"])
            at += n

    return f


def _strings(column: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, trees).T


def _count_cells(trees: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, 1 << CELL_BITS), np.int64)
        for batch in batches:
            for t, s in enumerate(_strings(batch.column(0), trees)):
                n[t] += np.bincount(s >> DEPTH - CELL_BITS, minlength=1 << CELL_BITS)
        t, cell = np.nonzero(n)
        yield pa.record_batch([pa.array(t.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[t, cell])], names=["tree", "cell", "n"])

    return f


def _table(counted: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Counts by (tree, cell), of which there are as many as parameters say."""
    out = np.zeros(shape, np.int64)
    for r in counted.groupBy("tree", "cell").agg(F.sum("n").alias("n")).collect():
        out[r["tree"], r["cell"]] = r["n"]
    return out


def _visits(strings: np.ndarray, counts: np.ndarray, wanted: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, tree, run) of each visit and the depth of each query: the runs (prefixes of `bits` bits) over and under its subtrees."""
    cells = strings >> DEPTH - CELL_BITS
    depth = ascended(cells, counts, wanted)
    trees, n = cells.shape
    runs = 1 << np.maximum(bits - depth, 0)
    first = cells >> CELL_BITS - bits
    first = np.where(depth < bits, first >> np.maximum(bits - depth, 0) << np.maximum(bits - depth, 0), first)
    query = np.repeat(np.tile(np.arange(n), trees), np.tile(runs, trees))
    tree = np.repeat(np.arange(trees), runs.sum())
    within = np.arange(len(query)) - np.repeat(np.cumsum(np.tile(runs, trees)) - np.tile(runs, trees), np.tile(runs, trees))
    return query, tree, np.repeat(first.ravel(), np.tile(runs, trees)) + within, depth


def _count_visits(trees: int, counts: np.ndarray, wanted: int, bits: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, 1 << bits), np.int64)
        for batch in batches:
            _, tree, run, _ = _visits(_strings(batch.column(0), trees), counts, wanted, bits)
            np.add.at(n, (tree, run), 1)
        t, run = np.nonzero(n)
        yield pa.record_batch([pa.array(t.astype(np.int32)), pa.array(run.astype(np.int32)), pa.array(n[t, run])], names=["tree", "cell", "n"])

    return f


def _blocks(rows: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A row's block of its run: rows are numbered in place, so multiplying spreads them evenly."""
    return (rows * 0x9E3779B1 >> 7) % salts


def _spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each repeat, and its number among the repeats of the same."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _deal_rows(trees: int, bits: int, row_blocks: np.ndarray, query_blocks: np.ndarray, dim: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, strings = batch.column(0).to_numpy(), _strings(batch.column(1), trees)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            scale = np.abs(v).max(axis=1)
            codes = np.rint(v / scale[:, None] * 127).astype(np.int8)
            coded = np.array([s.tobytes() + c.tobytes() for s, c in zip(scale / 127, codes, strict=True)], object)
            for t in range(trees):
                run = strings[t] >> DEPTH - bits
                at, q_block = _spread(query_blocks[t, run])
                if len(at):
                    block = _blocks(rows[at], row_blocks[t, run[at]])
                    yield pa.record_batch([pa.array((t << bits | run[at]).astype(np.int64)), pa.array(block.astype(np.int32)), pa.array(q_block.astype(np.int32)), pa.array(rows[at]), pa.array(strings[t][at]), pa.array(coded[at].tolist(), pa.binary())], names=["run", "block", "q_block", "row", "h", "coded"])

    return f


def _deal_queries(trees: int, bits: int, counts: np.ndarray, wanted: int, row_blocks: np.ndarray, query_blocks: np.ndarray, dim: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, strings = batch.column(0).to_numpy(), _strings(batch.column(1), trees)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v = (v / np.abs(v).max(axis=1, keepdims=True)).astype(np.float32)
            coded = np.array([x.tobytes() for x in v], object)
            query, tree, run, depth = _visits(strings, counts, wanted, bits)
            at, block = _spread(row_blocks[tree, run])
            query, tree, run = query[at], tree[at], run[at]
            for begin in range(0, len(at), 20_000):
                q, t, u, b = (x[begin : begin + 20_000] for x in (query, tree, run, block))
                q_block = _blocks(rows[q], query_blocks[t, u])
                yield pa.record_batch(
                    [pa.array((t << bits | u).astype(np.int64)), pa.array(b.astype(np.int32)), pa.array(q_block.astype(np.int32)), pa.array(rows[q]), pa.array(strings[t, q]), pa.array(depth[q].astype(np.int32)), pa.array(coded[q].tolist(), pa.binary())],
                    names=["run", "block", "q_block", "query", "h", "depth", "coded"],
                )

    return f


def subtrees(sorted_strings: np.ndarray, strings: np.ndarray, depths: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place of each query's subtree in a run: of its depth, or, from CELL_BITS on, the deepest that holds `wanted` places."""
    lo, hi = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    todo = np.arange(len(strings))
    for depth in range(DEPTH, -1, -1):
        low_bits = np.int64((1 << DEPTH - depth) - 1)
        if depth > CELL_BITS:
            here = todo[depths[todo] == CELL_BITS]
        else:
            here = todo[depths[todo] == depth]
        if not len(here):
            continue
        a = np.searchsorted(sorted_strings, strings[here] & ~low_bits, "left")
        b = np.searchsorted(sorted_strings, strings[here] | low_bits, "right")
        met = (b - a >= wanted) | (depth <= CELL_BITS)
        lo[here[met]], hi[here[met]] = a[met], b[met]
        todo = np.setdiff1d(todo, here[met], assume_unique=True)
    return lo, hi


def _rank(dim: int, keep: int, wanted: int):
    def f(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": np.empty(0, np.int64), "row": np.empty(0, np.int64), "about": np.empty(0), "slack": np.empty(0)})
        order = np.argsort(rows["h"].to_numpy(), kind="stable")
        strings, ids = rows["h"].to_numpy()[order], rows["row"].to_numpy()[order]
        raw = np.frombuffer(b"".join(rows["coded"].to_list()), np.uint8).reshape(-1, 8 + dim)[order]
        scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)[:, 0]
        codes = raw[:, 8:].view(np.int8).astype(np.float32)
        asked = np.frombuffer(b"".join(queries["coded"].to_list()), np.float32).reshape(-1, dim)
        lo, hi = subtrees(strings, queries["h"].to_numpy(), queries["depth"].to_numpy(), wanted)
        names = queries["query"].to_numpy()
        # a component is off by at most half a step: of the whole product this is three and a half deviations
        length = np.linalg.norm(asked, axis=1).astype(np.float64)
        found_query, found_row, found_score, found_slack = [], [], [], []
        # queries of one subtree are ranked in one product
        same = np.lexsort((hi, lo))
        cuts = np.flatnonzero((np.diff(lo[same]) != 0) | (np.diff(hi[same]) != 0)) + 1
        for who in np.split(same, cuts):
            a, b = lo[who[0]], hi[who[0]]
            if a == b:
                continue
            scores = (asked[who] @ codes[a:b].T).astype(np.float64) * scale[a:b]
            slack = length[who, None] * scale[a:b]
            last = np.partition(scores, b - a - keep, axis=1)[:, b - a - keep, None] if b - a > keep else -np.inf
            q, r = np.nonzero(scores + slack >= last)
            found_query.append(names[who[q]])
            found_row.append(ids[a + r])
            found_score.append(scores[q, r])
            found_slack.append(slack[q, r])
        if not found_query:
            return _rank(dim, keep, wanted)(rows.iloc[:0], queries)
        return pd.DataFrame({"query": np.concatenate(found_query), "row": np.concatenate(found_row), "about": np.concatenate(found_score), "slack": np.concatenate(found_slack)})

    return f


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows whose vector is neither null, empty nor zero, and has finite components only; null ids take no part."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))


def _nearest_rows(index: DataFrame, dim: int, n: int, k: int, trees: int, least: int) -> DataFrame:
    """(query, row) of rows of the index, worth an exact ranking: `index` has row, v, asked, and strings of rows and queries."""
    counts = _table(map_arrow(index.select("strings"), _count_cells(trees), "tree int, cell int, n long"), (trees, 1 << CELL_BITS))
    running = np.concatenate([np.zeros((trees, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
    wanted = enough(n, trees, least, k)
    bits = min(CELL_BITS, max(0, math.ceil(math.log2(n / BLOCK_ROWS)))) if n else 0
    queries = index.filter("asked")
    visits = _table(map_arrow(queries.select("as_query"), _count_visits(trees, running, wanted, bits), "tree int, cell int, n long"), (trees, 1 << bits))
    in_run = counts.reshape(trees, 1 << bits, -1).sum(axis=2)
    # runs beyond a block, of many close vectors, are cut; every part of one meets every part of its queries
    row_blocks, query_blocks = -(-in_run // BLOCK_ROWS), -(-visits // QUERY_ROWS)
    tasks = 1 + int((in_run * query_blocks).sum() + (visits * row_blocks).sum()) // TASK_ROWS
    key = ["run", "block", "q_block"]
    rows = map_arrow(index.select("row", "strings", "v"), _deal_rows(trees, bits, row_blocks, query_blocks, dim), "run long, block int, q_block int, row long, h long, coded binary")
    asked = map_arrow(queries.select("row", "as_query", "v"), _deal_queries(trees, bits, running, wanted, row_blocks, query_blocks, dim), "run long, block int, q_block int, query long, h long, depth int, coded binary")
    met = rows.repartition(tasks, *key).groupBy(*key).cogroup(asked.repartition(tasks, *key).groupBy(*key))
    found = met.applyInPandas(_rank(dim, k + SPARE, math.ceil(wanted / trees)), "query long, row long, about double, slack double")
    of_query = Window.partitionBy("query")
    once = found.groupBy("query", "row").agg(F.max("about").alias("about"), F.max("slack").alias("slack"))
    placed = once.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("about"), "row")))
    last = F.max(F.when(F.col("place") == k + SPARE, F.col("about"))).over(of_query)
    return placed.withColumn("last", last).filter((F.col("place") <= k + SPARE) | (F.col("about") + F.col("slack") >= F.col("last"))).select("query", "row")


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, trees: int = TREES, least: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the k found rows of largest inner product for each query row, its own id left out.

    Vectors are compared with those of as many components, in their own type, and scores are sums of products in double
    precision. Rows that agree in vec_id and vector count once, other equal vectors are candidates of their own; ties go to
    the smaller vec_id. Vectors that are null, empty, zero or have null or non-finite components, and null ids, take no part;
    an empty table gives no rows. `least` is a lowest number of rows met. Only vec_id, embedding and what is_query reads are used.
    """
    # adding 0 makes -0.0 and 0.0 one value
    zero = F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)
    v = F.transform("embedding", lambda x: x + zero)
    rows = usable(vectors).withColumn("asked", F.coalesce(is_query, F.lit(False)))
    rows = rows.select("vec_id", v.alias("v"), "asked").select("vec_id", "v", "asked", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("forest"), "v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"])
    rows = stash(rows, "forest-rows")
    # of equal vectors, the first ids are all that any query can find
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    kept = rows.withColumn("nth", first).filter(F.col("nth") <= k + 1)
    asked = rows.filter("asked").select("h1", "h2").distinct().withColumn("has_query", F.lit(True))
    classes = kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")).join(asked, ["h1", "h2"], "left").select("v", "h1", "h2", "ids", F.coalesce("has_query", F.lit(False)).alias("asked"))
    classes = stash(classes, "forest-classes")
    # lengths in units of the largest component, as squares of large ones are not finite
    most = classes.select("v", F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))).alias("most"))
    length = F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("most")) * (x.cast("double") / F.col("most"))))
    dims = most.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).collect()
    kind = classes.schema["v"].dataType.simpleString()
    out = None
    for dim, n, longest in sorted(map(tuple, dims)):
        own = classes.filter(F.size("v") == dim)
        schema = f"row long, v {kind}, h1 long, h2 long, ids array<long>, asked boolean, strings binary, as_query binary"
        index = stash(map_arrow(own.select("v", "h1", "h2", "ids", "asked"), _hash(trees, longest, dim, symbol_bits(n)), schema), "forest-index")
        pairs = _nearest_rows(index, dim, n, k, trees, least)
        found = _ranked_exactly(pairs, index, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    asking = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "h1", "h2")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    placed = asking.join(out, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("place", "b"))
    return placed.select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score"))


def _ranked_exactly(pairs: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(h1, h2, best): of each query's class, the k + 1 best ids with their scores, the best first."""
    of_row = index.select("row", F.col("v").alias("its_v"), "ids")
    of_query = index.filter("asked").select(F.col("row").alias("query"), F.col("v").alias("query_v"), "h1", "h2")
    product = F.zip_with("query_v", "its_v", lambda a, b: a.cast("double") * b.cast("double"))
    score = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(of_row, "row").join(of_query, "query").select("h1", "h2", score.alias("score"), "ids")
    order = Window.partitionBy("h1", "h2")
    best = scored.withColumn("nth", F.row_number().over(order.orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("nth") <= k + 1)
    ids = best.select("h1", "h2", (-F.col("score")).alias("away"), F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("nth", F.row_number().over(order.orderBy("away", "vec_id"))).filter(F.col("nth") <= k + 1)
    return ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("away", "vec_id"))).alias("best"))
