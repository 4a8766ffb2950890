"""Incremental ingest: uploads arrive as files, each micro-batch goes through the batch ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources.blobs import BlobStore, Snapshots

UPLOADS = "ingest_seq long, filename string, content binary"


def catalog_of(snapshots: Snapshots) -> dict[str, DataFrame]:
    """The catalog's tables, empty ones where there are none yet; the latest primary of each edition filled in."""
    out = {}
    for name in ("title", "edition", "artifact", "quarantine"):
        stored = snapshots.read(name)
        out[name] = ingest.empty(snapshots.spark, name) if stored is None else stored
    primary = snapshots.read("primary")
    if primary is not None:
        last = primary.groupBy(F.col("edition_id").alias("id")).agg(F.max_by("uid", "batch").alias("_uid"))
        out["edition"] = out["edition"].join(last, "id", "left").withColumn("primary_artifact_uid", F.col("_uid")).drop("_uid")
    return out


def start(spark: SparkSession, source: str, catalog: str, checkpoint: str, entries: DataFrame | None = None, once: bool = True, blobs: str | None = None) -> StreamingQuery:
    """Ingest Parquet files of uploads from ``source`` into the catalog.

    State lives in the catalog, not in the stream; a batch that is run again
    after a failure finds its contents stored and adds nothing. A batch appends
    its rows, so its cost follows the batch and the look-ups, not the catalog.
    Failed uploads go to the table ``error``, outcomes to ``outcome``, counts of
    each batch to ``progress``. With ``blobs`` decoded contents are stored there.
    """
    snapshots = Snapshots(spark, catalog, "stream")

    def batch(uploads: DataFrame, number: int) -> None:
        changes = ingest.ingest(catalog_of(snapshots), uploads, entries)
        if blobs:
            BlobStore(spark, blobs).put(ingest.decode(uploads))
        changes["primary"] = changes["primary"].withColumn("batch", F.lit(number).cast("long"))
        tally = changes["outcome"].agg(F.count_if(F.col("kind") == "stored").alias("stored"), F.count_if(F.col("kind") == "duplicate").alias("duplicate"), F.count_if("quarantined").alias("quarantined"), F.count_if("verified").alias("verified"))
        failed = changes["error"].agg(F.count("*").alias("failed"))
        changes["progress"] = tally.join(failed).select(F.lit(number).cast("long").alias("batch"), "*")
        snapshots.commit({}, changes)

    stream = spark.readStream.schema(UPLOADS).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
