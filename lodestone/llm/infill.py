"""Fill-in-the-middle over an index of distinct texts.

Documents meet by the digest of their text, sorted, so that copies stand one after another; a text is the same as the one before
it if all its bytes are. For each distinct text the byte offsets of its code points are written once as an Elias-Fano list, and
every document of the group takes its seeded cuts from that list: the place of code point k is one select. Outputs are then
put together from bytes in Spark's own functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_text, bound_batches, ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: In a hundred: documents that are transformed, and of those the ones whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: A text with more rows is dealt to several groups of about so many; at most HOT_TEXTS texts are known as such.
GROUP_ROWS = 128
HOT_TEXTS = 100_000
#: Every so many-th one of an Elias-Fano list has its place in the upper bits noted.
SAMPLE = 1024


def encode_boundaries(raw: bytes) -> bytes:
    """Elias-Fano list of the byte offsets at which code points begin, and of the text's end.

    Lower bits of each offset are packed, upper bits stand in unary: the bit at (upper + number) is set. The list has the
    number of code points, its lower bits' width and the place of every SAMPLE-th set bit in front.
    """
    data = np.frombuffer(raw, np.uint8)
    offsets = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw)).astype(np.int64)
    n = len(offsets)
    width = max(0, (len(raw) // n).bit_length() - 1)
    places = (offsets >> width) + np.arange(n)
    upper = np.zeros(int(places[-1]) + 1, np.uint8)
    upper[places] = 1
    lower = ((offsets[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    samples = places[::SAMPLE].astype("<i8")
    return struct.pack("<qqq", n - 1, width, len(samples)) + samples.tobytes() + np.packbits(lower.ravel()).tobytes() + np.packbits(upper).tobytes()


class Boundaries:
    """Reads an Elias-Fano list: `n` code points, and the byte offset of the k-th one by `select`."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.n, self.width, samples = struct.unpack_from("<qqq", data)
        self.samples = np.frombuffer(data, "<i8", samples, 24)
        self.lower = 24 + 8 * samples
        self.upper = self.lower + ((self.n + 1) * self.width + 7) // 8

    def _lower(self, k: int) -> int:
        """The packed lower bits of the k-th value, least bit first."""
        bits = range(k * self.width, (k + 1) * self.width)
        return sum((self.data[self.lower + b // 8] >> (7 - b % 8) & 1) << i for i, b in enumerate(bits))

    def select(self, k: int) -> int:
        sample, ahead = divmod(k, SAMPLE)
        begin = int(self.samples[sample])
        end = int(self.samples[sample + 1]) if sample + 1 < len(self.samples) else 8 * (len(self.data) - self.upper)
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, (end + 7) // 8 - begin // 8, self.upper + begin // 8))
        place = begin + int(np.flatnonzero(bits[begin % 8 :])[ahead])
        return (place - k) << self.width | self._lower(k)


def _cuts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Cuts in code points and bytes. Rows come sorted by digest: a list is made where a text differs from the one before."""
    text, index = None, None
    for raws, h1s, h2s in batches:
        out = []
        for raw, h1, h2 in zip(raws, h1s, h2s, strict=True):
            if index is None or raw != text:
                text, index = raw, Boundaries(encode_boundaries(raw))
            a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
            out.append((index.n, a, b, index.select(a), index.select(b)))
        yield pd.DataFrame(out, columns=["n", "a", "b", "a_byte", "b_byte"])


def _groups(docs: DataFrame) -> DataFrame:
    """doc_id and text; equal texts come together in sorted order. A text of many rows is dealt to groups of GROUP_ROWS or so."""
    keyed = docs.select("doc_id", as_text(F.col("text")).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = max(GROUP_ROWS, docs.count() // HOT_TEXTS)
    # a text has more than `rows` rows, so there are no more than HOT_TEXTS of them
    hot = keyed.groupBy("key").count().filter(F.col("count") > rows).select("key", F.ceil(F.col("count") / rows).alias("groups"))
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("group", F.pmod(F.monotonically_increasing_id(), F.coalesce("groups", F.lit(1))))
    return dealt.repartition("key", "group").sortWithinPartitions("key", "group").select("doc_id", "text")


def _digits(doc_id: Column, seed: str, nth: int) -> Column:
    """The nth group of 8 hex digits of sha256 of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output of every document.

    A text that is null, empty or holds a sentinel stays plain, and its cuts are null. Texts of any length are cut whole, equal
    rows are documents of their own, rows of one doc_id and different texts are cut each by its own length, an empty table
    gives no rows. Only doc_id, of any type, and text are read.
    """
    bound_batches(docs.sparkSession)
    ship_package(docs.sparkSession)
    cuts = F.pandas_udf(_cuts, "n long, a long, b long, a_byte int, b_byte int")
    id_, text = F.col("doc_id"), F.col("text")
    held = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when(held | (_digits(id_, seed, 2) % 100 >= transformed), "plain").when(_digits(id_, seed, 3) % 100 < suffix_first, "spm").otherwise("psm")
    raw = text.cast("binary")
    cut = _groups(docs).select("doc_id", "text", form.alias("form"), cuts(raw, _digits(id_, seed, 0), _digits(id_, seed, 1)).alias("at"))
    part = lambda begin, end: F.substring(raw, begin + 1, end - begin).cast("string")
    prefix, middle, suffix = part(F.lit(0), F.col("at.a_byte")), part(F.col("at.a_byte"), F.col("at.b_byte")), part(F.col("at.b_byte"), F.octet_length(raw))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    in_form = F.col("form") != "plain"
    return cut.select("doc_id", F.col("at.n").alias("n"), "form", F.when(in_form, F.col("at.a")).alias("prefix_chars"), F.when(in_form, F.col("at.b") - F.col("at.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Each sentinel stands in it once, as the text holds none."""
    last = F.substring_index(output, MIDDLE, -1)
    ahead = F.substring_index(output, MIDDLE, 1)
    first = F.substring_index(ahead, PREFIX, -1)
    psm = F.concat(F.substring_index(first, SUFFIX, 1), last, F.substring_index(ahead, SUFFIX, -1))
    spm = F.concat(first, last, F.substring_index(F.substring_index(ahead, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
