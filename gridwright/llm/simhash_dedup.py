"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint is cut into ``segments`` equal segments; the vector of
their bit counts is a point of a small integer grid. The Manhattan distance
of two points never exceeds the Hamming distance of the fingerprints, so
links are looked for only between points at distance 2 or less. Two such
points have a grid point within distance 1 of both, hence every fingerprint
goes to its own cell and to the neighbour cells at distance 1 and pairs meet
in a shared cell, where the exact bit distance decides.

Equal fingerprints are merged before, so groups of copies cost one row. A cell
with more than ``cell_limit`` fingerprints is not paired at all: its members
go on to cells of the fingerprints themselves at bit distance 1 (the grid with
64 segments), which hold 65 members at most and link exactly the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import keep_one, text_key, written
from gridwright.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 16
CELL_LIMIT = 256
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: bit set when set in over half the XXH64 (seed 42) values
    of the word shingles, repeats included; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h, ones, n, block = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []
    for g in grams:
        block.append(h(g, 42))
        if len(block) == _BLOCK:
            ones += np.unpackbits(np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n, block = n + _BLOCK, []
    if block:
        ones += np.unpackbits(np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, tk, fp`` (fp as signed bigint) for every row."""

    @F.pandas_udf("bigint")
    def simhash(texts):
        import pandas as pd
        v = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(v.view(np.int64))

    return docs.select("doc_id", text_key(F.col("text")).alias("tk"), simhash(F.col("text")).alias("fp"))


def cells(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(cell, fp)``: the own grid cell and the neighbours at distance 1."""
    width = 64 // segments
    base = width + 1  # a cell is a number with one digit, 0 to width, per segment
    assert segments * width == 64 and base ** segments < 1 << 63
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask).cast("bigint")))
              for i in range(segments)]
    d = fps.select("fp", F.array(*counts).alias("c"))
    key = sum((F.col("c")[i].cast("bigint") * F.lit(base ** i).cast("bigint") for i in range(segments)),
              F.lit(0).cast("bigint"))
    near = [F.col("k")]
    for i in range(segments):
        step = F.lit(base ** i).cast("bigint")
        near += [F.when(F.col("c")[i] < width, F.col("k") + step), F.when(F.col("c")[i] > 0, F.col("k") - step)]
    return (d.select("fp", "c", key.alias("k")).select("fp", F.explode(F.array(*near)).alias("cell"))
            .filter("cell is not null"))


def _forest(f: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the values ``f``."""
    u = f.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= max_bits
    left, out = np.ones(len(f), bool), []
    for s in range(len(f)):
        if not left[s]:
            continue
        left[s], todo = False, [s]
        while todo:
            x = todo.pop()
            for y in np.nonzero(near[x] & left)[0]:
                left[y] = False
                out.append((int(f[x]), int(f[y])))
                todo.append(int(y))
    return out


def _link_cells(max_bits: int, limit: int):
    """Streams rows sorted by cell; at most one batch and ``limit`` rows of a
    cell are held. Yields links (a, b) and, as (fp, fp), members of full cells."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hc = hf = np.empty(0, np.int64)
        full = None

        def rows(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def links(c, f):
            """All whole cells of the sorted arrays."""
            cut = np.flatnonzero(np.diff(c)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(c)]
            size = end - start
            two = start[size == 2]
            ok = np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= max_bits
            a, b = [f[two][ok]], [f[two + 1][ok]]
            more = [e for s, t in zip(start[size > 2], end[size > 2]) if t - s <= limit for e in _forest(f[s:t], max_bits)]
            if more:
                x = np.array(more, np.int64)
                a, b = a + [x[:, 0]], b + [x[:, 1]]
            for s, t in zip(start[size > limit], end[size > limit]):
                a, b = a + [f[s:t]], b + [f[s:t]]
            return rows(np.concatenate(a), np.concatenate(b))

        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False)
            if full is not None:
                n = int(np.searchsorted(c, full, "right"))
                yield rows(f[:n], f[:n])
                c, f = c[n:], f[n:]
                if not len(c):
                    continue
                full = None
            c, f = np.r_[hc, c], np.r_[hf, f]
            if not len(c):
                continue
            last = int(np.searchsorted(c, c[-1], "left"))
            if last:
                yield links(c[:last], f[:last])
            hc, hf = c[last:], f[last:]
            if len(hc) > limit:
                yield rows(hf, hf)
                full, hc, hf = hc[0], hc[:0], hf[:0]
        if len(hc):
            yield links(hc, hf)

    return link


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints, enough of them to
    connect whatever is connected at ``max_bits`` (2 at most) bits."""
    assert max_bits <= 2, "neighbour cells at distance 1 cover two bits"
    dealt = cells(fps, segments).select("cell", "fp").repartition("cell").sortWithinPartitions("cell")
    found = written(dealt.mapInArrow(_link_cells(max_bits, cell_limit), "a bigint, b bigint"), "links")
    over = found.filter("a = b").select(F.col("a").alias("fp")).distinct()
    if over.isEmpty():
        return found
    flips = [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint")) for i in range(64)]
    mid = over.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("cell"))
    dealt = mid.select("cell", "fp").repartition("cell").sortWithinPartitions("cell")
    return found.filter("a <> b").unionByName(dealt.mapInArrow(_link_cells(max_bits, 1 << 16), "a bigint, b bigint"))


def clusters(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
             cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Per row ``doc_id, tk, fp, component_id, keep_id, keep_tk, copies``:
    ``keep_*`` is the row that would stay, ``copies`` how many rows repeat its
    fingerprint, id and text."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    per_row = rows.groupBy("fp", "doc_id", "tk").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tk", "n")).alias("first")
    fps = written(per_row.groupBy("fp").agg(first), "distinct")
    roots = components(links(fps.select("fp"), max_bits, segments, cell_limit))
    tagged = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    best = tagged.groupBy("root").agg(F.min("first").alias("best"))
    by_fp = tagged.join(best, "root").select(
        "fp", F.col("best.doc_id").alias("component_id"), F.col("best.doc_id").alias("keep_id"),
        F.col("best.tk").alias("keep_tk"), F.col("best.n").alias("copies"))
    return rows.join(written(by_fp, "components"), "fp")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
                  cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Null and empty texts have fingerprint zero and link like any other.
    ``component_id`` is the smallest non-null doc_id of the component (null
    if it has none). Repeated rows and ties share a fingerprint and so a
    component; an empty table gives an empty result; other columns are
    ignored."""
    c = clusters(docs, shingle, max_bits, segments, cell_limit)
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns."""
    c = clusters(docs, shingle, max_bits)
    keep = c.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tk") == F.col("keep_tk")))
    return keep_one(docs, written(keep.select("doc_id", "tk", "copies").distinct(), "kept"))
