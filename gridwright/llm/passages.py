"""Word shingles and windows of whole texts in SQL functions only, shared by
benchmark decontamination and the license scan.

Words are the runs of letters and digits of the lower-cased text; a shingle is
the XXH64 of the hashes of ``SHINGLE`` words in a row. Windows are opened only
around shingles that some passage (benchmark item, license template) has too:
a window without any has similarity and containment zero, so nothing at or
above a threshold is lost, and the signatures of all other windows need not be
computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import text_key

SHINGLE = 5
LITERALS = 200_000  # more passage shingles than this are joined by a shuffle instead of shipped with the plan


def word_array(text: str) -> str:
    return f"split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+')"


def shingle_array(words: str) -> str:
    """SQL: the shingle hash at each word (at the last words, of fewer words).
    ``transform(array(x), ...)[0]`` binds a value once instead of inlining it."""
    more = ", ".join(f"get(w, i + {k})" for k in range(1, SHINGLE))
    return f"transform(array(transform({words}, x -> xxhash64(x))), w -> transform(w, (x, i) -> xxhash64(x, {more})))[0]"


def passage_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, sh``: word count and all shingle hashes, repeats included, of
    each passage with at least one whole shingle."""
    w = df.select(F.col(key).alias("key"), F.expr(f"filter({word_array(text)}, x -> x <> '')").alias("w"))
    return (w.withColumn("n", F.size("w")).filter(F.col("n") >= SHINGLE)
            .select("key", "n", F.expr(f"slice({shingle_array('w')}, 1, greatest(0, n - {SHINGLE - 1}))").alias("sh")))


def hit_windows(docs: DataFrame, passages: DataFrame, opened: str, literals: int = LITERALS, keyed: bool = False) -> DataFrame:
    """``doc_id, tk, n, start, win``: distinct windows of ``docs``; ``keyed``:
    also ``key``, a passage that shares a shingle with the window, one row each.

    ``opened`` is SQL over a hit (shingle number ``i`` in the document, ``p``
    in a passage of ``n`` words) that gives an array of ``(start, size)``
    windows in words; ``win`` has their shingle hashes."""
    own = ["n", "key"] if keyed else ["n"]
    marks = passages.select(*own, F.posexplode("sh").alias("p", "h")).distinct()
    few = marks.limit(literals + 1).count() <= literals  # the rows that would be broadcast, not only their hashes
    hashes = marks.select("h").distinct().collect() if few else []
    base = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")
    if few:
        if not hashes:
            hits = "filter(s, x -> false)"
        else:
            known = ", ".join(f"{r['h']}L" if r["h"] != -(1 << 63) else "(-9223372036854775807L - 1L)" for r in hashes)
            hits = f"filter(transform(s, (h, i) -> struct(i as i, h as h)), x -> x.h in ({known}))"
        bound = f"transform(array({shingle_array(word_array('text'))}), s -> struct(s as s, {hits} as hits))[0]"
        if not hashes:
            bound = bound.replace(hits, "cast(array() as array<struct<i: int, h: bigint>>)")
        found = (base.select("doc_id", "tk", F.expr(bound).alias("b"))
                 .select("doc_id", "tk", F.col("b.s").alias("s"), F.explode("b.hits").alias("hit"))
                 .select("doc_id", "tk", "s", F.col("hit.i").alias("i"), F.col("hit.h").alias("h"))
                 .join(F.broadcast(marks), "h"))
        at = found.select("doc_id", "tk", "s", *own, F.explode(F.expr(opened)).alias("at"))
    else:
        each = base.select("doc_id", "tk", F.posexplode(F.expr(shingle_array(word_array("text")))).alias("i", "h"))
        at = (each.join(marks, "h").select("doc_id", "tk", *own, F.explode(F.expr(opened)).alias("at"))
              .groupBy("doc_id", "tk").agg(F.collect_set(F.struct(*own, "at")).alias("all")))  # windows of one document
        r = at.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "all")
        s = base.select("doc_id", "tk", F.expr(shingle_array(word_array("text"))).alias("s"))
        at = (s.join(r, s["doc_id"].eqNullSafe(r["_id"]) & (s["tk"] == r["_tk"]))
              .select("doc_id", "tk", "s", F.explode("all").alias("x"))
              .select("doc_id", "tk", "s", "x.*"))
    start = "greatest(at.start, 0)"
    win = at.select("doc_id", "tk", *own, F.expr(start).alias("start"),
                    F.expr(f"slice(s, {start} + 1, at.size - {SHINGLE - 1})").alias("win"))
    # one row per window: identical rows, so any of them will do
    return win.groupBy("doc_id", "tk", *own, "start").agg(F.max("win").alias("win"))
