"""Links as streams: incremental ingest, windows over attributed links, pipelines that remember what they made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkframe.operators.linkset import Linkset, digest
from linkframe.plans.pipeline import Pipeline
from linkframe.schema import cut
from linkframe.sources.formats import ntriples


def read_links(spark: SparkSession, path: str) -> Linkset:
    """Parquet folders of links as a stream."""
    from linkframe.schema import LINK_SCHEMA

    return Linkset(spark.readStream.schema(LINK_SCHEMA).parquet(path))


def read_ntriples(spark: SparkSession, path: str, **options) -> Linkset:
    """N-Triples files as they arrive; repeated links are for the sink or ``unseen`` to take out."""
    return ntriples(spark.readStream.text(path), dedup=False, **options)


def window_counts(events: DataFrame, at: str, by: list[Column | str], length: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, keys, n) per window, with a watermark: a window is final when the stream is ``late`` beyond its end."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, keys, n) per session: events of a key with no more than ``gap`` between."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def unseen(links: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """The first of equal links within the watermark; the state does not grow beyond it."""
    return links.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def _earlier(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame | None:
    """What batches before ``n`` wrote; None before the first."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < n).drop("batch")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def run_pipeline(links: Linkset, pipeline: Pipeline, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A pipeline over a stream of links, a batch at a time: links are appended to ``out/links``, each once over all batches.
    Entities of earlier batches are not created again, but new links that rules make of them are written. ``out/ids`` and
    ``out/seen`` hold what was made, only what is new in each batch: an id, or a digest of 16 bytes a link. Every batch has
    its own folders, which a rerun of that batch overwrites, so a failure leaves nothing twice."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        known, seen = _earlier(spark, f"{out}/ids", "out_rid string", n), _earlier(spark, f"{out}/seen", "link_digest binary", n)
        r = pipeline.run(Linkset(df), known)
        made = r.output.df.withColumn("link_digest", digest())
        ids = r.entities if r.entities is not None else spark.createDataFrame([], "out_rid string")
        if known is not None:
            ids = ids.join(known, "out_rid", "left_anti")
        if seen is not None:
            made = made.join(seen, "link_digest", "left_anti")
        made = cut(made)
        made.drop("link_digest").write.mode("overwrite").parquet(f"{out}/links/batch={n}")
        made.select("link_digest").write.mode("overwrite").parquet(f"{out}/seen/batch={n}")
        ids.write.mode("overwrite").parquet(f"{out}/ids/batch={n}")

    return links.df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def to_completion(df: DataFrame, path: str, checkpoint: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a streaming DataFrame over what is there now, into Parquet files, and read them."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(df.schema).parquet(path)
    return then(out) if then else out
