"""Text files whose name order is their content's order, and a manifest.

A text is a list of sections: small lists of lines, or tables with a ``line``
column whose partitions, one behind the other, are the section. Every
partition is written to a folder of its own, ``section=<n>/piece=<partition>``,
both numbers of fixed width, so name order is text order whatever the number
of partitions (Spark's own part numbers have five digits). No position is
computed and nothing is shuffled again: a ranged table is written as it is.

``_manifest.json``, written last, lists the files in order with their sizes.
It commits the text: a folder without it is unfinished, and the reader refuses
files that the manifest does not name or that differ in size.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION_DIGITS, PIECE_DIGITS = 6, 12
MANIFEST = "_manifest.json"


class ManifestError(ValueError):
    """The folder does not hold what its manifest lists."""


def section_name(section: int) -> str:
    return f"section={section:0{SECTION_DIGITS}d}"


def _piece() -> Column:
    """Number of the partition as text; name order is number order."""
    return F.lpad(F.spark_partition_id().cast("string"), PIECE_DIGITS, "0")


def ranged(df: DataFrame, order: Sequence[Column], num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with the partition's
    name in ``_piece``. The rows are sorted by it first, so a write into
    folders by ``_piece`` finds them in order."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("_piece", _piece()).sortWithinPartitions("_piece", *order)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_section(lines: DataFrame, path: str) -> None:
    if "_piece" not in lines.columns:  # partitions as they come
        lines = lines.withColumn("_piece", _piece()).withColumn("_at", F.monotonically_increasing_id()) \
            .sortWithinPartitions("_piece", "_at")
    lines.select(F.col("_piece").alias("piece"), "line").write.partitionBy("piece").text(path)


def listed_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``(section/piece/file, bytes)`` of the text files below ``path``, in
    name order."""
    fs, root = _fs(spark, path)
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        parts = f.getPath().toString().rsplit("/", 3)[1:]
        if f.getLen() and parts[2].startswith("part-"):
            found.append(("/".join(parts), f.getLen()))
    return sorted(found)


def write_ordered(spark: SparkSession, sections: Sequence[Sequence[str] | DataFrame], path: str) -> None:
    """Write the sections in order, then the manifest. An earlier text at
    ``path`` is removed first."""
    fs, root = _fs(spark, path)
    if fs.exists(root):
        fs.delete(root, True)
    for k, s in enumerate(sections):
        if not isinstance(s, DataFrame):
            s = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(x) for x in s])).alias("line"))
        _write_section(s, f"{path}/{section_name(k)}")
    files = listed_files(spark, path)
    out = fs.create(_fs(spark, f"{path}/{MANIFEST}")[1], True)
    out.write(bytearray(json.dumps({"files": files}).encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a text in order, checked against the folder."""
    fs, p = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        raise ManifestError(f"{path} has no manifest: it is not a finished text")
    stream = fs.open(p)
    text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    want = [tuple(x) for x in json.loads(text)["files"]]
    check_manifest(want, listed_files(spark, path))
    return want


def check_manifest(want: Sequence[tuple[str, int]], found: Sequence[tuple[str, int]]) -> None:
    if list(want) != sorted(want):
        raise ManifestError("the manifest is not in name order")
    if list(want) != list(found):
        odd = sorted(set(map(tuple, want)) ^ set(map(tuple, found)))
        raise ManifestError(f"{len(odd)} files differ from the manifest, the first is {odd[0][0]}")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """``section, piece, block, at, line``: the lines of a checked text; sorted
    by the first four columns they are the text. ``block`` is the place of a
    file split, ``at`` counts the lines of a read task upward."""
    manifest(spark, path)
    lines = spark.read.schema("value string, section string, piece string").text(path)
    return lines.select("section", "piece", F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
