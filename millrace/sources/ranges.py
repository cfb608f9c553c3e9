"""Files of any size by byte ranges, as a data source whose partitions are ranges, and digests of whole files as trees over their leaves.

    spark.dataSource.register(ByteRanges)
    spark.read.format("byte_ranges").option("path", folder).load()

A file is leaves of LEAF bytes; a partition reads a range of whole leaves, a leaf at a time. A file's digest is that of its leaves' digests, by groups of FAN
until one is left: it depends on the leaves only, not on how many of them a range has. Folders are listed and files opened by pyarrow's file
systems (local, mounted, S3, GCS, HDFS); no file is ever one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import stored

#: Bytes of a leaf, leaves of a range, digests below a node of the tree.
LEAF, RANGE_LEAVES, FAN = 1 << 20, 64, 1024


class FileRange(InputPartition):
    def __init__(self, path: str, size: int, first: int, leaves: int):
        self.path, self.size, self.first, self.leaves = path, size, first, leaves


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.leaf, self.leaves = int(options.get("leaf", LEAF)), int(options.get("rangeleaves", RANGE_LEAVES))

    def partitions(self) -> list[InputPartition]:
        """Ranges of the files below the folder: names and sizes are all that the driver reads."""
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.suffix))
        step = self.leaf * self.leaves
        return [FileRange(path, size, at // self.leaf, self.leaves) for path, size in files for at in range(0, max(size, 1), step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as file:
            file.seek(partition.first * self.leaf)
            for number in range(partition.first, partition.first + partition.leaves):
                held = file.read(self.leaf)
                if held or not number:
                    yield partition.path, partition.size, number, len(held), held.count(b"\n"), hashlib.sha256(held).hexdigest()
                if len(held) < self.leaf:
                    return


class ByteRanges(DataSource):
    """[S-27] (path, size, leaf, bytes, newlines, digest) of every leaf of the files below `path`; options suffix, leaf, rangeLeaves."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, size long, leaf long, bytes long, newlines long, digest string"

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("byte_ranges needs a path")
        return RangeReader(dict(self.options))


def tree_digests(leaves: DataFrame, fan: int | None = None) -> DataFrame:
    """[F-19, V-17] (path, size, newlines, leaves, digest) of files from their leaves: digests of `fan` neighbours are joined and digested, level by
    level, until each file has one."""
    fan = fan or FAN
    sums = stored(leaves.groupBy("path", "size").agg(F.sum("newlines").alias("newlines"), F.count("*").alias("leaves")), "file_sums")
    level, most = leaves.select("path", F.col("leaf").alias("at"), "digest"), sums.agg(F.max("leaves")).first()[0] or 0
    while True:
        ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        level = level.groupBy("path", F.floor(F.col("at") / fan).alias("at")).agg(F.sha2(ordered, 256).alias("digest"))
        most = -(-most // fan)
        if most <= 1:
            return sums.join(level.select("path", "digest"), "path")


def fingerprints(spark: SparkSession, path: str, suffix: str = "", leaf: int = LEAF, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """[S-27, J-21] (path, size, newlines, leaves, digest) of all files below a folder; see tree_digests."""
    spark.dataSource.register(ByteRanges)
    read = spark.read.format("byte_ranges").option("path", path).option("suffix", suffix).option("leaf", str(leaf)).option("rangeLeaves", str(range_leaves))
    return tree_digests(read.load())
