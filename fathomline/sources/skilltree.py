"""A batch source for directory trees: one row per file, hidden files and mode bits included.

Spark's own file sources skip names that begin with a dot or underscore and carry no mode
bits, so the tree is listed here. Each top-level entry below the root is a partition; the
content column is read only where the query asks for it (options content=false, suffixes).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "root string, rel_path string, name string, mode int, length bigint, head binary, content binary"


class _Branch(InputPartition):
    def __init__(self, top: str | None):
        self.top = top


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root = os.path.abspath(options["path"])
        self.want = options.get("content", "true").lower() == "true"
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)

    def partitions(self) -> list[InputPartition]:
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Branch(None), *[_Branch(t) for t in tops]]

    def read(self, partition: _Branch) -> Iterator[tuple]:
        if partition.top is None:
            walks = [(self.root, [], sorted(e.name for e in os.scandir(self.root) if not e.is_dir(follow_symlinks=False)))]
        else:
            walks = os.walk(os.path.join(self.root, partition.top))
        for folder, _, names in walks:
            for name in sorted(names):
                full = os.path.join(folder, name)
                try:
                    info = os.lstat(full)
                    if not stat.S_ISREG(info.st_mode):
                        continue
                    wanted = self.want and (not self.suffixes or name.endswith(self.suffixes) or name.startswith("."))
                    with open(full, "rb") as f:
                        head = f.read(2)
                        content = head + f.read() if wanted else None
                except OSError:
                    continue  # unreadable files count as absent
                rel = os.path.relpath(full, self.root).replace(os.sep, "/")
                yield self.root, rel, name, info.st_mode & 0o7777, info.st_size, head, content


class SkillTree(DataSource):
    """spark.read.format("skilltree").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "skilltree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_tree(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """All regular files below a folder. A missing folder is an error, as with Spark's own sources."""
    place = os.path.abspath(os.path.expanduser(folder))
    if not os.path.isdir(place):
        raise FileNotFoundError(f"no such folder: {folder}")
    spark.dataSource.register(SkillTree)
    return spark.read.format("skilltree").options(**options).load(place)
