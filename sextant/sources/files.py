"""Files, indexes and graphs as tables, and back."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import excluded, extension, language

#: The default file types and excluded folders.
TYPES = ["py", "ts", "js", "md", "vue"]
EXCLUDE = ["node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build"]


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sextant-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A fresh path in that folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: written to the shared folder and read back, so that a lost executor repeats nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decode(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def skip_reason(path: Column, length: Column, types=TYPES, dirs=EXCLUDE, max_size: int = 1 << 20) -> Column:
    """Why a file isn't indexed; null if it is."""
    return F.when(excluded(path, dirs), "excluded").when(~extension(path).isin(types), "type").when(length > max_size, "size")


FILE_SCHEMA = "path string, length long, modified timestamp, content_hash string, language string, text string, skip_reason string"


def scan(spark: SparkSession, root: str, types=TYPES, dirs=EXCLUDE, max_size: int = 1 << 20) -> DataFrame:
    """path, length, modified, content_hash, language, text, skip_reason of every file below root; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], FILE_SCHEMA)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.withColumn("skip_reason", skip_reason(F.col("path"), F.col("length"), types, dirs, max_size))
    text = F.when(F.col("skip_reason").isNull(), decode(F.col("content")))
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("content_hash"), language(F.col("path")).alias("language"), text.alias("text"), "skip_reason")


def save_tables(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON file with two lists."""
    g = spark.read.option("multiLine", True).json(path)
    return g.select(F.explode("nodes").alias("n")).select("n.*"), g.select(F.explode("edges").alias("e")).select("e.*")


def save_graph(path: str, nodes: DataFrame, edges: DataFrame, statistics: DataFrame) -> None:
    """Three folders of JSON lines."""
    for name, df in (("nodes", nodes), ("edges", edges), ("statistics", statistics)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_graph_folders(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as save_graph wrote them, with their schemas."""
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/edges")
