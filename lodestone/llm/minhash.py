"""Near-duplicate groups by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

Equal shingle sets become one node. One hash per shingle falls into one of 256 bins and each bin keeps its smallest; an empty
bin copies from a filled one that a hash chooses. Bands of six bins make buckets. Each bucket offers only pairs of its most
connected node with the others, and exact set sizes confirm them. Nodes that share a bucket but are still in different
components are then compared block by block, which returns only links, so that no link that a bucket shows is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import held, map_arrow, portions, stash, task_number, utf8, whole_row
from lodestone.plans.components import connected_components

#: A set's bins, and bins in a band. A pair of Jaccard 0.8 shares none of 42 bands once in 350,000 times.
BIN_BITS, BAND = 8, 6
BINS = 1 << BIN_BITS
BANDS = BINS // BAND
SHINGLE_WORDS, PERCENT = 2, 80
#: Words that a worker remembers the hashes of.
MEMO = 300_000
#: Nodes whose sets are fetched by a broadcast of their ids; of more, by a shuffle.
BROADCAST_NODES = 500_000
#: Pairs of a node that share a key of the join with its set, and how many nodes are known to have more, at most.
RAYS, BROADCAST_HUBS = 200, 100_000
#: A component with more than one in so many of all nodes is named by a broadcast.
LARGE = 1000
#: Nodes and shingles in a block of a group, and columns of a block's matrix that are multiplied at once.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 800, 400_000, 2048

_mix = np.random.default_rng(97).integers(0, BINS, (4096, BINS))
_odd = np.random.default_rng(98).integers(1, 1 << 63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all of them."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo: dict[bytes, int] = held(("word hashes",), dict)
    try:
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8; of fewer words, of the whole sequence.

    bytes.lower() touches A-Z alone, and bytes.split() parts at exactly \\x20 and \\x09-\\x0D.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.zeros(n, np.uint64) + np.uint64(width)
    for i in range(width):
        out = finish(out * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n])
    return np.unique(out)


def densified(distinct: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; sorted hashes whose top bits are the bin. An empty bin takes that of a bin drawn by hash, again until it isn't empty."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
    at = np.searchsorted(distinct, edges)
    held = distinct[np.minimum(at, len(distinct) - 1)]
    filled = (at < len(distinct)) & ((held >> np.uint64(64 - BIN_BITS)) == np.arange(BINS, dtype=np.uint64))
    if filled.all():
        return held
    out = np.where(filled, held, 0)
    empty = np.flatnonzero(~filled)
    for draw in _mix:
        hit = filled[draw[empty]]
        out[empty[hit]] = held[draw[empty[hit]]]
        empty = empty[~hit]
        if not len(empty):
            return out
    out[empty] = held[np.flatnonzero(filled)[0]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    rows = signature[: BANDS * BAND].reshape(BANDS, BAND)
    mixed = finish((finish(rows) * _odd).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed.view(np.int64)


def _sketch(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = task_number() << 33, 0
        for batch in portions(batches, 1):
            sizes, keys, buckets = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                buckets.append(bands(densified(s)) if len(s) else None)
            n = len(sizes)
            yield pa.record_batch(
                [batch.column(0), pa.array(range(part + at, part + at + n), pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), batch.column(2)],
                names=["doc_id", "row", "n_shingles", "set_key", "buckets", "text_key"],
            )
            at += n

    return f


def _sets(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "set_key", "members"])

    return f


def _with_side(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """`rows`, of these pairs, with the set of their node `side`. A node of many pairs, a star's hub, is dealt by its partners to keys of RAYS pairs or so, each of which gets its set once."""
    rays = max(RAYS, pairs.count() // BROADCAST_HUBS)
    # a hub has more than `rays` pairs, so there are fewer than BROADCAST_HUBS of them
    hubs = F.broadcast(pairs.groupBy(side).count().filter(F.col("count") > rays).select(side, F.ceil(F.col("count") / rays).alias("keys")))
    keys = F.coalesce("keys", F.lit(1))
    dealt = rows.join(hubs, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), keys)).drop("keys")
    held = sets.select(F.col("node").alias(side), F.col("members").alias(f"of_{side}")).join(hubs, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), keys - 1))).drop("keys")
    return dealt.join(held, [side, "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = _with_side(_with_side(pairs, pairs, sets, "a", "b"), pairs, sets, "b", "a")
    with_sets = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return with_sets.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("sizes") - F.col("common"))).select("a", "b")


def _node_sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, members) of the nodes in pairs, from their first documents' texts."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stash(nodes.join(wanted, "node").select("node", "set_key", "first_doc"), "minhash-wanted")
    few = wanted.count() <= BROADCAST_NODES
    ids = wanted.select(F.col("first_doc").alias("_first")).distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    members = map_arrow(texts.select(F.col("doc_id"), utf8(F.col("text")).alias("text")), _sets(size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set_key binary, members array<long>")
    keys = wanted.select("node", F.col("set_key").alias("_key"))
    found = members.join(F.broadcast(keys) if few else keys, F.col("set_key") == F.col("_key"))
    return stash(found.select("node", "members").dropDuplicates(["node"]), "minhash-sets")


def _compare(percent: int):
    def f(group: pd.DataFrame) -> pd.DataFrame:
        sets, nodes, components = group["members"].to_list(), group["node"].to_numpy(), group["component"].to_numpy()
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.float64)
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # a shingle of one set adds to no intersection
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
        row = np.repeat(np.arange(n), sizes.astype(np.int64))
        row, column = row[column >= 0], column[column >= 0]
        common = np.zeros((n, n))
        for first in range(0, int((times > 1).sum()), COLUMNS):
            here = (column >= first) & (column < first + COLUMNS)
            x = np.zeros((n, COLUMNS), np.float32)
            x[row[here], column[here] - first] = 1
            common += x @ x.T
        linked = 100 * common >= percent * (sizes[:, None] + sizes - common)
        a, b = np.nonzero(np.triu(linked & (components[:, None] != components), 1))
        a, b = nodes[a], nodes[b]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return f


def _links_in_groups(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among nodes that share a bucket, directly or through others; (node, n, component, hub) of buckets.

    A group is cut into blocks of bounded size and each pair of blocks is a task's unit. A unit multiplies the 0/1 matrix of
    its sets with itself, which gives all intersections exactly, and returns the links alone.
    """
    edges = placed.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = connected_components(edges).select("node", F.col("component").alias("group"))
    members = placed.select("node", "n", "component").distinct().join(groups, "node")
    blocks = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = other.select("node", "component", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "node")
    return units.groupBy("group", "i", "j").applyInPandas(_compare(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component and text_key (md5 of the text) of every document.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. Null, empty and blank texts
    have an empty set, are linked with nothing and are their own component. component_id is the smallest doc_id of the
    component (a null doc_id counts only if there is no other); kept says that it is the row's own. Rows of equal
    doc_id count as documents of their own. `component` numbers the groups. Texts of any length are compared whole, an empty
    table gives no rows, and only doc_id, of any type with an order, and text are read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(docs.select("doc_id", utf8(F.col("text")).alias("text"), text_key(F.col("text")).alias("text_key")), _sketch(size), f"doc_id {kind}, row long, n_shingles long, set_key binary, buckets array<long>, text_key binary")
    rows = stash(rows, "minhash-rows")
    nodes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    nodes = stash(nodes, "minhash-nodes")

    entries = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    entries = stash(entries.join(shared, "bucket"), "minhash-buckets")
    degree = entries.groupBy("node").agg(F.sum("m").alias("degree"))
    hubs = entries.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    star = entries.join(hubs, "bucket").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    star = stash(star, "minhash-star")
    sets = _node_sets(docs, star, nodes, size)
    links = stash(_confirmed(star, sets, percent), "minhash-links")
    found = stash(connected_components(links), "minhash-components")

    # what the stars left apart: buckets whose nodes are still in several components
    placed = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    placed = stash(placed.join(mixed, "bucket").join(hubs, "bucket").select("node", "n", "component", "hub"), "minhash-mixed")
    more = stash(_links_in_groups(placed, sets, percent), "minhash-more-links")
    if more.take(1):
        found = stash(connected_components(links.unionByName(more)), "minhash-components")

    of_node = nodes.select("set_key", "node", "first_doc").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = stash(of_node, "minhash-placed")
    first = stash(of_node.groupBy("component").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("m")), "minhash-first")
    # components of many nodes, fewer than LARGE by what makes them large, don't become keys of a shuffle
    large = first.filter(F.col("m") > (first.agg(F.sum("m")).first()[0] or 0) / LARGE).select("component", F.struct("component_id").alias("of_large"))
    told = of_node.join(F.broadcast(large), "component", "left")
    small = told.filter("of_large IS NULL").drop("of_large").join(first.drop("m"), "component")
    of_node = small.unionByName(told.filter("of_large IS NOT NULL").withColumn("component_id", F.col("of_large.component_id")).drop("of_large")).select("set_key", "node", "component", "component_id")
    full = rows.filter("n_shingles > 0").join(of_node, "set_key").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "component", "text_key")
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.col("row").alias("component"), "text_key")
    return full.unionByName(empty)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(utf8(text)))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """`docs` without the other members of each group; of equal rows one stays, and every document without words.

    The row that stays has the component's id; if several rows do, as different texts can share a doc_id, the one of the
    smallest md5 does. A null or blank text is in no group and stays, texts of any length are compared whole, an empty table
    stays empty, and other columns stay whatever their names.
    """
    of_text = near_duplicates(docs, **options).filter("kept AND n_shingles > 0").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    keep = stash(of_text.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_key", "n"), "text_key").alias("k")), "minhash-keep")
    n, repeats = keep.agg(F.count("*"), F.coalesce(F.max("k.n"), F.lit(0))).first()
    has_words = F.length(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0
    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("its_doc"), text_key(F.col("text")).alias("its_text"), has_words.alias("its_words"))
    ids = keep.select(F.col("k.doc_id").alias("of_doc"), F.col("k.text_key").alias("of_text"))
    out = rows.filter("its_words").join(F.broadcast(ids) if n <= BROADCAST_NODES else ids, F.col("its_doc").eqNullSafe(F.col("of_doc")) & (F.col("its_text") == F.col("of_text")))
    if repeats > 1:
        turn = F.row_number().over(Window.partitionBy("its_doc", "its_text").orderBy(F.lit(0)))
        out = out.withColumn("turn", turn).filter("turn = 1")
    return out.select("doc.*").unionByName(rows.filter(~F.col("its_words")).select("doc.*"))
