"""Benchmark decontamination, SQL functions only.

1. Item-sized windows are opened where a document shares a shingle with an
   item (``passages.hit_windows``): at the place where that shingle aligns both
   and at the shingle itself. The second kind misses no passage, whatever the
   order of its parts: moving a window right to its first shared shingle drops
   only shingles that the item does not have.
2. Equal windows become one; each gets a 64-bit SimHash of its shingles.
3. A multi-index over ``BLOCKS`` blocks of the fingerprint finds the items among
   those that share a shingle with the window: items are filed under every block value within ``FLIPS`` bits, so
   a window within ``RADIUS`` bits shares a key in at least one block
   (pigeonhole: 8 blocks, each off by 3 bits or more, make 24).
4. Candidates are verified by the exact weighted similarity of the shingles:
   sum of the smaller counts over sum of the larger counts.

``RADIUS`` is that wide because it must not lose pairs: at similarity 0.8 a
window shares 8 of 9 shingles, two such fingerprints differ in 10 bits on
average, with a standard deviation of 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import drop_keys, written
from gridwright.llm.passages import LITERALS, hit_windows, passage_table

SIMILARITY = 0.8
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1


def simhash_sql(hashes: str) -> str:
    return (f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * size(filter({hashes}, "
            f"h -> (shiftright(h, b) & 1L) = 1L)) > size({hashes}), shiftleft(1L, b), 0L))")


def _blocks(df: DataFrame, *cols: str) -> DataFrame:
    """One row per block: its number and value."""
    width = 64 // BLOCKS
    block = f"transform(sequence(0, {BLOCKS - 1}), k -> shiftright(fp, k * {width}) & {(1 << width) - 1}L)"
    return df.select(*cols, F.posexplode(F.expr(block)).alias("block", "value"))


def similarity_sql(x: str, y: str) -> str:
    """Weighted Jaccard: shingle counts as weights."""
    common = (f"aggregate(array_distinct({x}), 0, (acc, h) -> acc + least(size(filter({x}, v -> v = h)), "
              f"size(filter({y}, v -> v = h))))")
    return f"transform(array({common}), c -> c / (size({x}) + size({y}) - c))[0]"


def candidates(windows: DataFrame, kinds: DataFrame, filed: DataFrame) -> DataFrame:
    """``n, wk, key, bits``: windows and items that share a shingle and a block
    value within ``FLIPS`` bits, and lie within ``RADIUS`` bits. A window is
    looked up under the items whose shingle opened it, never under all items
    of its size, so candidates grow with the shared shingles."""
    near = f"filter(sequence(0, {(1 << (64 // BLOCKS)) - 1}), m -> bit_count(m) <= {FLIPS})"
    index = (_blocks(filed.withColumnRenamed("fp", "ifp").withColumn("fp", F.col("ifp")), "key", "n", "ifp")
             .select("key", "n", "ifp", "block", "value", F.explode(F.expr(near)).alias("m"))
             .select("key", "n", "ifp", "block", F.expr("value ^ cast(m as bigint)").alias("value")))
    opened = windows.select("n", F.xxhash64("win").alias("wk"), "key").distinct().join(kinds.select("n", "wk", "fp"), ["n", "wk"])
    probe = _blocks(opened, "n", "wk", "key", "fp")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    return (probe.join(index, ["key", "n", "block", "value"]).filter(bits <= RADIUS)
            .select("n", "wk", "key", bits.alias("bits")).distinct())


def signed(windows: DataFrame) -> DataFrame:
    """``n, wk, win, fp``: the different windows and their SimHash."""
    return (windows.select("n", "win", F.xxhash64("win").alias("wk")).groupBy("n", "wk").agg(F.max("win").alias("win"))
            .select("n", "wk", "win", F.expr(simhash_sql("win")).alias("fp")))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
          literals: int = LITERALS) -> DataFrame:
    """``doc_id, tk, item_id, window_start, window_words, bits, similarity``:
    the most similar window of each contaminated row and item."""
    items = passage_table(benchmark.filter("item_id is not null"), "item_id", "text")
    windows = written(hit_windows(docs, items, "array(struct(i - p as start, n as size), struct(i as start, n as size))", literals,
                                  keyed=True), "windows")
    kinds = written(signed(windows), "window-kinds")
    filed = written(items.select("key", "n", "sh", F.expr(simhash_sql("sh")).alias("fp")), "items")
    sure = (candidates(windows, kinds, filed).join(kinds.select("n", "wk", "win"), ["n", "wk"])
            .join(filed.select("key", "n", "sh"), ["key", "n"])
            .select("n", "wk", "key", "bits", F.expr(similarity_sql("win", "sh")).alias("similarity"))
            .filter(F.col("similarity") >= similarity))
    best = F.max(F.struct("similarity", (-F.col("bits")).alias("b"), (-F.col("start")).alias("s"), "n")).alias("x")
    return (windows.select("doc_id", "tk", "key", "n", "start", F.xxhash64("win").alias("wk")).join(sure, ["n", "wk", "key"])
            .groupBy("doc_id", "tk", F.col("key").alias("item_id")).agg(best)
            .select("doc_id", "tk", "item_id", (-F.col("x.s")).alias("window_start"), F.col("x.n").alias("window_words"),
                    (-F.col("x.b")).alias("bits"), F.col("x.similarity").alias("similarity")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, window_start, window_words, bits, similarity``: one
    row per document and benchmark item whose passage it holds.

    Null and empty texts hold nothing. Items of fewer than five words have no
    shingle and are not looked for; items with a null id or text neither.
    Repeated rows give one row. Of equally similar windows the one with fewer
    differing bits counts, then the first, then the longest; a document has a
    row for every item it holds, so items do not tie.
    Documents shorter than an item are compared whole. Empty tables give an
    empty result; other columns are ignored."""
    return leaks(docs, benchmark, similarity).drop("tk")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns."""
    return drop_keys(docs, written(leaks(docs, benchmark, similarity).select("doc_id", "tk").distinct(), "leaks"))
