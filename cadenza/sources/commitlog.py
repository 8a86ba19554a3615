"""A log of appended batches in a folder: readers see whole batches only, in the order in which they were committed.

    data/<batch name>/part-*          what the tasks of an append wrote
    commits/<number, 20 digits>.json  a line for each file of the batch: batch, place (the file's order), file, and what the writer says of it

An append writes its data under a new name first, then its list of files under a temporary name, and renames that to the next number.
Renaming never replaces a file, so of two writers that took the same number one takes the next. An append that dies before that leaves data that no
list names: nobody reads it, and vacuum removes it. Lines keep their order: batch, file, block of the file, line.

A batch that replaces stands for all before it (a compaction): readers begin at the last such one.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The lines of commits.
COMMIT = "batch bigint, place int, file string, replaces boolean, said string"
_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset a session on one machine gets a new
    folder (tests), and a cluster's an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="cadenza-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """The few file operations that Spark has no reader or writer for, by the file system of the path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.hadoop, self.conf = spark, spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        root = self.hadoop.Path(path)
        self.fs = root.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(root).toString().rstrip("/")

    def at(self, name: str = ""):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def renamed(self, old: str, new: str) -> bool:
        """False, and nothing happens, if there is a file of the new name."""
        options = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)
        try:
            self.hadoop.FileContext.getFileContext(self.at().toUri(), self.conf).rename(self.at(old), self.at(new), options)
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = Folder(spark, path)
    return folder.fs.exists(folder.at("commits"))


def commit(spark: SparkSession, path: str, files: list[str], replaces: bool = False, said: str | None = None) -> int:
    """Adds a batch of files (names below the log's folder, in order) and returns its number."""
    folder = Folder(spark, path)
    folder.fs.mkdirs(folder.at("commits"))
    temporary = f"commits/.{uuid.uuid4().hex}"  # readers pass over names that begin with a point
    taken = [int(n[:20]) for n in folder.names("commits") if re.fullmatch(r"\d{20}\.json", n)]
    number = max(taken, default=-1) + 1
    while True:
        lines = [{"batch": number, "place": i, "file": f, "replaces": replaces, "said": said} for i, f in enumerate(files or [""])]
        folder.write(temporary, "".join(json.dumps(line) + "\n" for line in lines))
        if folder.renamed(temporary, f"commits/{number:020d}.json"):
            return number
        folder.remove(temporary)
        number += 1


def written(lines: DataFrame, path: str) -> list[str]:
    """Writes the column value of lines as text, compressed, under a new name and returns the names of its files; without a commit nobody reads them."""
    name = f"data/{uuid.uuid4().hex}"
    lines.select("value").write.option("compression", "gzip").text(f"{path.rstrip('/')}/{name}")
    return [f"{name}/{n}" for n in Folder(lines.sparkSession, path).names(name) if n.startswith("part-")]


def append(lines: DataFrame, path: str, replaces: bool = False) -> int:
    """Adds the lines (value) as a batch, in the order of their partitions, and returns its number."""
    return commit(lines.sparkSession, path, written(lines, path), replaces)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of the batches that count: the last one that replaces, and those after it."""
    if not exists(spark, path):
        return spark.createDataFrame([], COMMIT)
    rows = spark.read.schema(COMMIT).json(f"{path.rstrip('/')}/commits")
    first = rows.agg(F.max(F.when(F.col("replaces"), F.col("batch"))).alias("first"))
    return rows.crossJoin(F.broadcast(first)).where("first IS NULL OR batch >= first").drop("first")  # one row


def lines(spark: SparkSession, path: str) -> DataFrame:
    """pos and line of all batches that count. pos ascends by batch, file, block and line: the last line written has the largest."""
    schema = T.StructType([T.StructField("pos", T.StructType.fromDDL("batch bigint, place int, block bigint, n bigint")), T.StructField("line", T.StringType())])
    folder = Folder(spark, path)
    if not exists(spark, path) or not folder.names("data"):
        return spark.createDataFrame([], schema)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1)
    rows = spark.read.option("recursiveFileLookup", True).text(f"{folder.path}/data")
    rows = rows.select(F.col("value").alias("line"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.join(commits(spark, path), "file").select(F.struct("batch", "place", "block", "n").alias("pos"), "line")


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes data that no batch that counts names; how many names went. For times without writers: what one is writing is not named yet."""
    folder = Folder(spark, path)
    named = {r.name for r in commits(spark, path).select(F.split("file", "/")[1].alias("name")).distinct().collect()}  # a row per batch
    gone = [n for n in folder.names("data") if n not in named]
    for n in gone:
        folder.remove(f"data/{n}")
    return len(gone)
