"""A catalog of key-value tables: rows (row_key, col, value, seq) as Parquet folders under one base folder.

Names that start with `pt-` are persistent, others live as temporary views of the session. A put appends a cell;
readers resolve the log by the greatest seq of a cell.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

CELLS = "row_key string, col string, value string, seq long"


class Conflict(ValueError):
    """A rename that the rules forbid."""


class Catalog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.views: dict[str, DataFrame] = {}
        self.gone: set[str] = set()
        self.said: list[str] = []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(name)) if name.startswith("pt-") else name in self.views

    def tables(self) -> list[str]:
        there = [x.getPath().getName() for x in self.files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.base))]
        return sorted([x for x in there if x.startswith("pt-")] + list(self.views))

    def scan(self, name: str) -> DataFrame:
        """The log of cells; a table that does not exist is empty, one that was deleted raises."""
        if name in self.gone:
            raise LookupError(f"{name} was deleted")
        if not self.exists(name):
            return self.spark.createDataFrame([], CELLS)
        return self.spark.read.schema(CELLS).parquet(f"{self.base}/{name}") if name.startswith("pt-") else self.views[name]

    def latest(self, name: str) -> DataFrame:
        """(row_key, col, value), last write wins."""
        return self.scan(name).groupBy("row_key", "col").agg(F.max_by("value", "seq").alias("value"))

    def put(self, name: str, cells: DataFrame) -> None:
        """Appends cells (row_key, col, value, seq)."""
        cells = cells.select("row_key", "col", "value", F.col("seq").cast("long").alias("seq"))
        self.gone.discard(name)
        if name.startswith("pt-"):
            cells.write.mode("append").parquet(f"{self.base}/{name}")
        else:
            self.views[name] = self.views[name].union(cells) if name in self.views else cells

    def get_row(self, name: str, row: str) -> DataFrame:
        return self.latest(name).where(F.col("row_key") == row).groupBy("row_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "value")))).alias("values"))

    def get(self, name: str, row: str, col: str) -> str | None:
        got = self.scan(name).where((F.col("row_key") == row) & (F.col("col") == col)).agg(F.max_by("value", "seq")).first()
        return got[0]

    def exists_row(self, name: str, row: str) -> bool:
        return not self.scan(name).where(F.col("row_key") == row).isEmpty()

    def range_scan(self, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of start <= key < end; None is open."""
        d = self.latest(name)
        d = d if start is None else d.where(F.col("row_key") >= start)
        return d if end is None else d.where(F.col("row_key") < end)

    def count(self, name: str) -> int:
        return self.scan(name).select("row_key").distinct().count()

    def save_bag(self, name: str, bag: DataFrame) -> None:
        """A row an element, column `value`; replaces the table."""
        self.delete(name, missing_ok=True)
        self.put(name, bag.select(F.expr("uuid()").alias("row_key"), F.lit("value").alias("col"), "value", F.lit(0).alias("seq")))

    def save_pairs(self, name: str, pairs: DataFrame) -> None:
        """A row a key, its values in columns of their own; replaces the table."""
        self.delete(name, missing_ok=True)
        self.put(name, pairs.select(F.col("k").alias("row_key"), F.expr("uuid()").alias("col"), F.col("v").alias("value"), F.lit(0).alias("seq")))

    def bag(self, name: str) -> DataFrame:
        """A saved table as a bag."""
        return self.scan(name).select("value")

    def pairs(self, name: str) -> DataFrame:
        """A saved table as pairs."""
        return self.scan(name).select(F.col("row_key").alias("k"), F.col("value").alias("v"))

    def rename(self, old: str, new: str) -> None:
        if old.startswith("pt-") and not new.startswith("pt-"):
            raise Conflict("a persistent table cannot become transient")
        if not self.exists(old):
            raise LookupError(old)
        if self.exists(new):
            raise Conflict(f"{new} exists")
        if old.startswith("pt-"):
            self.files.rename(self._path(old), self._path(new))
        elif new.startswith("pt-"):
            self.views.pop(old).write.parquet(f"{self.base}/{new}")
        else:
            self.views[new] = self.views.pop(old)

    def delete(self, name: str, missing_ok: bool = False) -> None:
        if not self.exists(name):
            if missing_ok:
                return
            raise LookupError(name)
        if name.startswith("pt-"):
            self.files.delete(self._path(name), True)
        else:
            del self.views[name]
        self.gone.add(name)

    def output(self, text: str) -> None:
        """Appends to the job's result text."""
        self.said.append(text)

    def result(self) -> str:
        return "".join(self.said) or "There was no output"
