"""Content-addressed blobs and catalog snapshots on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable


class BlobStore:
    """Blobs in Parquet, partitioned by the first two digits of their sha1."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def blobs(self) -> DataFrame:
        """``sha1``, ``byte_len``, ``content``; catalog queries that skip content never read it."""
        if not self._exists():
            return self.spark.createDataFrame([], "sha1 string, byte_len long, content binary, shard string")
        return self.spark.read.schema("sha1 string, byte_len long, content binary, shard string").parquet(self.root)

    def put(self, contents: DataFrame, content: str = "content") -> DataFrame:
        """Store new contents; ``sha1``, ``is_new`` of each distinct one. Storing again changes nothing."""
        one = contents.where(F.col(content).isNotNull()).select(F.sha1(content).alias("sha1"), F.col(content).alias("content")).dropDuplicates(["sha1"])
        marked = durable(one.join(self.blobs().select("sha1").withColumn("old", F.lit(True)), "sha1", "left"))
        fresh = marked.where(F.col("old").isNull())
        fresh.select("sha1", F.length("content").cast("long").alias("byte_len"), "content", F.substring("sha1", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(self.root)
        return marked.select("sha1", F.col("old").isNull().alias("is_new"))

    def get(self, wanted: DataFrame) -> DataFrame:
        return self.blobs().join(wanted.select("sha1").distinct(), "sha1", "left_semi")


class Snapshots:
    """Catalog tables as numbered commits on a shared file system.

    A commit holds whole tables or rows to append to them; a reader takes the
    last whole one and all appended after it, up to the current commit, so it
    never sees a half-written one. A writer claims its number before it writes
    data: a second writer fails, and the same one may try again after a failure.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str = "owner"):
        self.spark, self.root, self.owner = spark, root, owner

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> set[str]:
        fs, p = self._fs(path)
        return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()

    def current(self) -> int:
        """Number of the current commit, 0 for none."""
        return int(max(self._names(f"{self.root}/_current"), default="0"))

    def read(self, name: str) -> DataFrame | None:
        paths = []
        for n in range(self.current(), 0, -1):
            have = self._names(f"{self.root}/{n:09d}")
            if f"{name}.rows" in have:
                paths.append(f"{self.root}/{n:09d}/{name}.rows")
            if name in have:
                paths.append(f"{self.root}/{n:09d}/{name}")
                break
        return self.spark.read.parquet(*paths[::-1]) if paths else None

    def _claim(self, n: int) -> None:
        fs, p = self._fs(f"{self.root}/_claims/{n:09d}-{self.owner}")
        others = {x for x in self._names(f"{self.root}/_claims") if x.startswith(f"{n:09d}-")} - {p.getName()}
        if not others and not fs.exists(p):
            fs.create(p, False).close()
            others = {x for x in self._names(f"{self.root}/_claims") if x.startswith(f"{n:09d}-")} - {p.getName()}
        if others:
            raise RuntimeError(f"commit {n} is claimed by another writer: {sorted(others)}")

    def commit(self, tables: dict[str, DataFrame], rows: dict[str, DataFrame] | None = None) -> int:
        """Write ``tables`` whole and append ``rows``, then point to the commit (an atomic file creation)."""
        n = self.current() + 1
        self._claim(n)
        for name, df in [*tables.items(), *((f"{k}.rows", v) for k, v in (rows or {}).items())]:
            df.write.mode("overwrite").parquet(f"{self.root}/{n:09d}/{name}")
        fs, p = self._fs(f"{self.root}/_current/{n:09d}")
        fs.create(p, False).close()
        return n
