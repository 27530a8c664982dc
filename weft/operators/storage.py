"""Cutting lineage in the shared folder that spark.checkpoint.dir names."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets its own, a cluster session an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    base = shared_dir(df.sparkSession)
    if not context.getCheckpointDir() or base not in context.getCheckpointDir():
        context.setCheckpointDir(base)
    return df.checkpoint()


def written(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """The same rows, written to the shared folder once and read again; held gets the table's path."""
    path = f"{shared_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, held: list[str]) -> None:
    """Deletes the tables of held, which nothing reads any more."""
    for path in held:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    held.clear()
