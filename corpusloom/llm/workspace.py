"""Tables that cut a plan's lineage: written to the shared folder that the cluster names, read again, dropped when used up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Partitions that a task which writes few files takes at most, and the tasks a core that there are at least.
MERGED, WAVES = 8, 4


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset a session whose tasks all run in this machine's one process sets a temporary folder of its own; any other is
    told to name a folder, as executors on several machines share no local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """A folder of intermediate tables.  A table that a lost executor's tasks need again is still there, as files that all share.

    Tables go as soon as they are used up (``drop``); what results still read, and the folder itself, go when the driver's process ends.

    few_files: a task that writes a table takes up to MERGED partitions one after the other, as long as there are WAVES tasks a core.  On a local
    or mounted folder Hadoop's file system starts about six processes a file to set its rights, and each counts as a copy of the executor's JVM
    until it runs its own program.  With dynamic allocation the cores aren't known, and each partition has a task of its own.
    """

    def __init__(self, spark: SparkSession, name: str, few_files: bool = False):
        self.spark = spark
        self.few_files = few_files
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        where, files = self._hadoop(self.path)
        files.mkdirs(where)
        files.deleteOnExit(where)

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        most = self._tasks() if self.few_files else None
        (df.coalesce(most) if most else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["workspace_path"] = path
        return out

    def _tasks(self) -> int | None:
        """Tasks that a table is written by at most; none if that is left open."""
        context = self.spark.sparkContext
        if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
            return None
        return max(WAVES * context.defaultParallelism, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // MERGED))

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no plan still to be run reads."""
        for t in tables:
            if path := t.__dict__.get("workspace_path"):
                where, files = self._hadoop(path)
                files.delete(where, True)

    def close(self) -> None:
        """Deletes the folder: for callers that have written what they were given."""
        where, files = self._hadoop(self.path)
        files.delete(where, True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is none of ``taken``, whatever the case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
