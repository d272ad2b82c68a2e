"""What the operators of this subpackage share: scratch tables, text access, table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words everywhere in this subpackage.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one on a local master (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestream-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder during one operator call.

    They cut lineage, survive lost executors, and are deleted by ``close``.  What an operator
    returns must not read them: it is handed over through ``keep``, a reliable checkpoint.  Spark removes
    its files when the last frame using them is gone if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on; else they stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write and reread ``df``; ``by``: columns of folders, so that a read of some values skips the rest."""
        at = f"{self.path}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(at, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)

    def close(self) -> None:
        self.drop()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns never clash with an operator's own names."""
    return docs.select(*(F.col(f"`{c}`").alias(c) for c in columns))
