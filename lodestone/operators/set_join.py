"""Joins of new sets with an index of existing ones: new rows probe, and existing rows are never paired among themselves.

All sets are put in one order of words, rare ones first. Two sets as similar as a threshold asks share a word among the first
few of either, and where that word stands bounds what they can have in common. For the k nearest, the k-th score found so far
is such a threshold: it rises while a candidate's words are read, and ends the reading. At a high threshold two sets share parts
of several words (`set_parts`), and the index keeps the sets alone: parts are made while it is asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import set_parts
from lodestone.session import stash

#: Words that are put last, by how many sets hold them, at most; the others are rarer and are put in order of letters.
FREQUENT = 100_000
#: Words and pairs of the new side that are broadcast at most; more are shuffled.
BROADCAST_WORDS, BROADCAST_PAIRS = 200_000, 200_000
#: Pairs that a task scores at a time, about, and those of one group of near copies.
UNIT_PAIRS, GROUP_PAIRS = 5_000, 200_000
#: Words of a candidate that the first round of a search for the nearest reads, and how many times as many have been read after the next one.
FIRST_WORDS, WIDER = 12, 4
_EPS = 1e-9


@dataclass(frozen=True)
class SetIndex:
    """`frequent` words from the rarest on; sets (set_key, n, words in order); postings (token, set_key, n, place); members (set_key, id).

    With `weights`, it is one of parts: `set_key` is the first id of a set, `postings` has (set_key, words' digests) of such ids.
    """

    frequent: tuple[str, ...]
    sets: DataFrame
    postings: DataFrame
    members: DataFrame
    weights: np.ndarray | None = None


def keyed(rows: DataFrame) -> DataFrame:
    """(id, tokens) -> (id, set_key, sorted tokens); empty sets go."""
    ordered = rows.select("id", F.sort_array("tokens").alias("tokens")).filter(F.size("tokens") > 0)
    return ordered.select("id", F.unhex(F.sha2(F.array_join("tokens", " ").cast("binary"), 256)).alias("set_key"), "tokens")


def in_order(spark: SparkSession, tokens: Column, frequent: tuple[str, ...]) -> Column:
    """The order that all sets share: rare words by letters, then frequent ones from the rarest on."""
    told = spark.sparkContext.broadcast({w: i for i, w in enumerate(frequent)})

    @F.pandas_udf("array<string>")
    def ordered(sets: pd.Series) -> pd.Series:
        place = told.value
        return sets.map(lambda words: sorted([w for w in words if w not in place]) + sorted([w for w in words if w in place], key=place.__getitem__))

    return ordered(tokens)


def frequent_words(rows: DataFrame, most: int) -> tuple[str, ...]:
    """The words that most sets of `tokens` hold, from the rarest on: `most` of them or somewhat fewer, as those of about one count come together."""
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    counts = stash(counts.withColumn("step", F.floor(F.log2("n") * 8)), "sets-counts")
    least = None
    for r in counts.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        most -= r["words"]
        if most < 0:
            break
        least = r["step"]
    if least is None:
        return ()
    return tuple(r["token"] for r in sorted(counts.filter(F.col("step") >= least).select("token", "n").collect(), key=lambda r: (r["n"], r["token"])))


def shared(common: Column) -> Column:
    """How many words among their first ones two sets must share that are to have so many in common."""
    return 1 + F.floor(common / 32)


def prefix(n: Column, threshold: float) -> Column:
    """Of how many first words two sets of that similarity share as many as `shared` says."""
    return (n - F.ceil(F.lit(threshold) * n - _EPS) + shared(n)).cast("int")


def build(existing: DataFrame, threshold: float = 0.0, folder: str | None = None, frequent: int = FREQUENT) -> SetIndex:
    """An index of (id, tokens) for searches at `threshold` or above; kept in `folder`, or else with the other tables of the session.

    Rows of one set are one entry with several members. Empty sets aren't in it, as they are like nothing. A posting is made
    for each of a set's first words that the threshold asks for: for all of them at 0. From `set_parts.LEAST` on nothing is
    posted: rows' words stay where they are, and of the rows of one set the first by id is asked.
    """
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: stash(df, f"sets-{name}")
    if folder:
        keep = lambda df, name: _written(df, f"{folder}/{name}")
    if threshold >= set_parts.LEAST:
        sets = keep(existing.withColumn("digest", F.unhex(F.sha2(F.array_join(F.sort_array("tokens"), " ").cast("binary"), 256))), "sets")
        ids = sets.filter(F.size("tokens") > 0).select("id", "digest")
        first = ids.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
        copies = keep(ids.join(first, "digest").filter(F.col("id") != F.col("first")).select("id", "digest"), "copies")
        weights = set_parts.weights(set_parts.hashed(sets.filter(F.size("tokens") > 0).select("tokens")))
        if folder:
            _written(existing.sparkSession.createDataFrame(pd.DataFrame({"weight": weights}).reset_index(names="counter")), f"{folder}/weights")
        return _of_parts(sets, copies, weights)
    rows = stash(keyed(existing), "sets-keyed")
    last = frequent_words(rows, frequent)
    once = rows.groupBy("set_key").agg(F.first("tokens").alias("tokens"))
    sets = keep(once.select("set_key", F.size("tokens").alias("n"), in_order(existing.sparkSession, F.col("tokens"), last).alias("words")), "sets")
    first = F.slice("words", 1, prefix(F.col("n"), threshold)) if threshold > 0 else F.col("words")
    postings = sets.select("set_key", "n", F.posexplode(first).alias("place", "token")).select("token", "set_key", "n", (F.col("place") + 1).alias("place"))
    members = keep(rows.select("set_key", "id"), "members") if folder else rows.select("set_key", "id")
    if folder:
        postings = postings.repartitionByRange("token", "set_key").sortWithinPartitions("token", "set_key")
        existing.sparkSession.createDataFrame(list(enumerate(last)), "place int, token string").write.mode("overwrite").parquet(f"{folder}/frequent")
        postings = keep(postings, "postings")
    return SetIndex(last, sets, postings, members)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few(keys: DataFrame, n: int) -> DataFrame:
    """`keys` as the told side of a join, if they are few."""
    return F.broadcast(keys) if n <= BROADCAST_PAIRS else keys


def _of_parts(sets: DataFrame, copies: DataFrame, weights: np.ndarray) -> SetIndex:
    firsts = sets.filter(F.size("tokens") > 0).join(_few(copies, copies.count()), ["id", "digest"], "left_anti")
    known = sets.select(F.col("id").alias("set_key"), F.size("tokens").alias("n"), F.col("tokens").alias("words"))
    return SetIndex((), known, set_parts.hashed(firsts.select(F.col("id").alias("set_key"), "tokens")), sets.select(F.col("id").alias("set_key"), "id"), weights)


def open_index(spark: SparkSession, folder: str) -> SetIndex:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    sets = read("sets")
    if "digest" in sets.columns:
        told = read("weights").toPandas()
        weights = np.zeros(set_parts.COUNTERS, np.int64)
        weights[told["counter"].to_numpy()] = told["weight"].to_numpy()
        return _of_parts(sets, read("copies"), weights)
    frequent = tuple(r["token"] for r in read("frequent").orderBy("place").collect())
    return SetIndex(frequent, sets, read("postings"), read("members"))


def _candidates(candidates: DataFrame, index: SetIndex) -> tuple[DataFrame, DataFrame]:
    """(id, x) of candidates with words, and each of their sets once: (x, n, words)."""
    rows = stash(keyed(candidates).withColumnRenamed("set_key", "x"), "sets-candidates")
    once = rows.groupBy("x").agg(F.first("tokens").alias("tokens"))
    return rows.select("id", "x"), once.select("x", F.size("tokens").alias("n"), in_order(candidates.sparkSession, F.col("tokens"), index.frequent).alias("words"))


def _met(probe: DataFrame, postings: DataFrame, n_words: int) -> DataFrame:
    """(x, set_key) of sets that a probe (x, n, place, token, least) can be as similar to as `least`, by length and place of a shared word."""
    p = postings.select("token", "set_key", F.col("n").alias("n_y"), F.col("place").alias("place_y"))
    met = p.join(F.broadcast(probe) if n_words <= BROADCAST_WORDS else probe, "token")
    n, n_y = F.col("n"), F.col("n_y")
    # the words from this one on are all that can be common, if it is the first common one
    common = F.least(n - F.col("place"), n_y - F.col("place_y")) + 1
    return met.filter(common >= F.col("least") * (n + n_y - common) - _EPS).select("x", "set_key").distinct()


def _score_unit(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    words: dict[tuple[bool, str], list[frozenset]] = {}
    for new, name, w in zip(sets["new"], sets["name"], sets["words"], strict=True):
        words.setdefault((bool(new), name), []).append(frozenset(w))
    out = []
    for x, key, own, known in zip(pairs["x"], pairs["set_key"], pairs["own"], pairs["known"], strict=True):
        a = words[True, own][0]
        for b in words[False, known]:
            n = len(a & b)
            out.append((x, key, n / (len(a) + len(b) - n)))
    return pd.DataFrame(out, columns=["x", "set_key", "score"])


def _scored(pairs: DataFrame, own: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, set_key, score) of pairs by the sets themselves, which go to a unit once for all its pairs there."""
    pairs = stash(pairs, "sets-pairs")
    n = pairs.count()
    # pairs of a group of near copies have one smallest set; those of a large group are cut into squares
    label = pairs.groupBy("x").agg(F.min("set_key").alias("label"))
    sides = pairs.join(label, "x").groupBy("label").agg(F.ceil(F.sqrt(F.count("*") / GROUP_PAIRS)).alias("side"))
    cut = [F.pmod(F.xxhash64(c), F.col("side")) for c in ("x", "set_key")]
    dealt = stash(pairs.join(label, "x").join(sides, "label").select("x", "set_key", F.pmod(F.xxhash64("label", *cut), F.lit(n // UNIT_PAIRS + 1)).alias("unit")), "sets-units")

    def members(key: str, rows: DataFrame, new: bool) -> DataFrame:
        asked = dealt.select(F.col("unit").alias("of"), F.col(key).alias("key")).distinct()
        # met before the join, whatever its order: the others' words aren't shuffled
        wanted = rows.select(F.col(key).alias("key"), "words").join(_few(asked.select("key").distinct(), n), "key", "left_semi")
        return asked.join(wanted, "key").select("of", F.lit(new).alias("new"), F.hex("key").alias("name"), "words")

    kind = {c: dealt.schema[c].dataType.simpleString() for c in ("x", "set_key")}
    both = members("x", own, True).unionByName(members("set_key", sets, False))
    named = dealt.select("unit", "x", "set_key", F.hex("x").alias("own"), F.hex("set_key").alias("known"))
    return named.groupBy("unit").cogroup(both.groupBy("of")).applyInPandas(_score_unit, f"x {kind['x']}, set_key {kind['set_key']}, score double")


def _similar_by_parts(own: DataFrame, index: SetIndex, threshold: float) -> DataFrame:
    """(x, set_key) of pairs that show equal parts of several words."""
    probe = set_parts.signed(set_parts.hashed(own.select("x", F.col("words").alias("tokens"))), threshold, index.weights)
    n = own.agg(F.sum("n")).first()[0] or 0
    known = set_parts.signed(index.postings, threshold, index.weights)
    told = F.broadcast(probe.alias("r")) if n <= BROADCAST_WORDS else probe.alias("r").hint("merge")
    met = known.alias("l").join(told, [F.col("l.key") == F.col("r.key"), set_parts.may_meet("l", "r", threshold)])
    return met.groupBy("x", "set_key").agg(F.sum(set_parts.share("l", "r", threshold)).alias("shown")).filter(F.col("shown") >= set_parts.WHOLE).select("x", "set_key")


def similar(candidates: DataFrame, index: SetIndex, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(x, set_key, score) of all indexed sets at least as similar as that to a candidate's set, and (id, x) of the candidates.

    Sets that must have `least` words in common have `least - m + 1` of them from the m-th on, so none of the first m stands
    later than that leaves room for. Only pairs that show m such words are compared.
    """
    if index.weights is not None:
        if threshold < set_parts.LEAST:
            raise ValueError(f"an index of parts isn't asked below {set_parts.LEAST}")
        rows = stash(keyed(candidates).withColumnRenamed("set_key", "x"), "sets-candidates")
        first = rows.groupBy("x").agg(F.min("id").alias("id"))
        own = rows.join(_few(first, first.count()), ["id", "x"], "left_semi").select("x", F.size("tokens").alias("n"), F.col("tokens").alias("words"))
        found = _scored(_similar_by_parts(own, index, threshold), own, index.sets)
        return found.filter(F.col("score") >= threshold - _EPS), rows.select("id", "x")
    ids, own = _candidates(candidates, index)
    own = stash(own, "sets-own")
    first = F.slice("words", 1, prefix(F.col("n"), threshold))
    probe = own.select("x", "n", F.posexplode(first).alias("place", "token")).withColumn("place", F.col("place") + 1)
    n_words = own.agg(F.sum(prefix(F.col("n"), threshold))).first()[0] or 0
    postings = index.postings.filter(F.col("place") <= prefix(F.col("n"), threshold)).select("token", "set_key", F.col("n").alias("n_y"), F.col("place").alias("place_y"))
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_y")) - _EPS)
    room = F.least(F.col("n") - F.col("place"), F.col("n_y") - F.col("place_y"))
    met = postings.join(F.broadcast(probe) if n_words <= BROADCAST_WORDS else probe, "token").filter(room >= least - shared(least))
    met = met.groupBy("x", "set_key").agg(F.count("*").alias("shown"), F.min(shared(least)).alias("needed")).filter("shown >= needed")
    found = _scored(met.select("x", "set_key"), own, index.sets)
    return found.filter(F.col("score") >= threshold - _EPS), ids


def most_similar(candidates: DataFrame, index: SetIndex, threshold: float) -> DataFrame:
    """(id, duplicate_of, score): each candidate as similar as that to an indexed row, the most similar one, the first by id among equals."""
    found, ids = similar(candidates, index, threshold)
    # read twice
    found = stash(found, "sets-scored")
    best = found.groupBy("x").agg(F.max("score").alias("score"))
    top = stash(found.join(best, ["x", "score"]), "sets-top")
    firsts = index.members.join(top.select("set_key").distinct(), "set_key", "left_semi").groupBy("set_key").agg(F.min("id").alias("first"))
    chosen = top.join(firsts, "set_key").groupBy("x").agg(F.min("first").alias("duplicate_of"), F.first("score").alias("score"))
    return ids.join(chosen, "x").select("id", "duplicate_of", "score")


def nearest(candidates: DataFrame, index: SetIndex, k: int) -> DataFrame:
    """(candidate, rank, neighbour, score): the k most similar indexed rows of each candidate by positive similarity, ties by id. `index` is one of threshold 0.

    Rounds read a candidate's words, rare ones first, until no set that holds none of those read can reach the k-th score.
    """
    ids, own = _candidates(candidates, index)
    state = stash(own.withColumn("least", F.lit(0.0)).withColumn("since", F.lit(0)).withColumn("upto", F.least("n", F.lit(FIRST_WORDS))), "sets-state")
    found: list[DataFrame] = []
    while True:
        read = F.slice("words", F.col("since") + 1, F.col("upto") - F.col("since"))
        n_words = state.agg(F.sum(F.col("upto") - F.col("since"))).first()[0]
        if not n_words:
            break
        probe = state.select("x", "n", "least", "since", F.posexplode(read).alias("place", "token")).select("x", "n", "least", "token", (F.col("since") + F.col("place") + 1).alias("place"))
        pairs = _met(probe, index.postings, int(n_words))
        for before in found:
            pairs = pairs.join(before.select("x", "set_key"), ["x", "set_key"], "left_anti")
        found.append(stash(_scored(pairs, state, index.sets), "sets-found"))
        so_far = reduce(DataFrame.unionByName, found)
        kth = so_far.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score")))).filter(F.col("place") <= k)
        kth = kth.groupBy("x").agg(F.count("*").alias("m"), F.min("score").alias("lowest")).filter(F.col("m") == k)
        bound = F.coalesce("lowest", F.lit(0.0))
        # a set without the first words of a candidate has at most the others in common with it
        last = F.least(F.col("n"), F.floor(F.col("n") * (1 - bound) + 1 + _EPS).cast("int"))
        following = state.join(kth, "x", "left").select("x", "n", "words", bound.alias("least"), F.col("upto").alias("since"), F.least(last, WIDER * F.col("upto")).alias("upto"))
        state = stash(following.filter("upto > since"), "sets-state")
    if not found:
        some = index.members.select(F.col("id").alias("neighbour")).limit(0)
        return ids.select(F.col("id").alias("candidate"), F.lit(1).alias("rank"), F.lit(0.0).alias("score")).limit(0).join(some).select("candidate", "rank", "neighbour", "score")
    top = reduce(DataFrame.unionByName, found)
    # sets below the k-th score of a candidate have no place; of the members of one set the k first can count
    top = top.withColumn("place", F.rank().over(Window.partitionBy("x").orderBy(F.desc("score")))).filter((F.col("place") <= k) & (F.col("score") > 0)).drop("place")
    top = stash(top, "sets-top")
    of_set = index.members.join(top.select("set_key").distinct(), "set_key", "left_semi")
    of_set = of_set.withColumn("nth", F.row_number().over(Window.partitionBy("set_key").orderBy("id"))).filter(F.col("nth") <= k).select("set_key", F.col("id").alias("neighbour"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "neighbour"))
    best = top.join(of_set, "set_key").withColumn("rank", rank).filter(F.col("rank") <= k)
    return ids.select(F.col("id").alias("candidate"), "x").join(best, "x").select("candidate", "rank", "neighbour", "score")
