"""Recent observations as a stream of landed pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, readings as serve
from ..plans import jobs
from ..sources import files

#: How long after the newest instant seen an older one still takes observations, and how far back a batch loads.
LATENESS, WINDOW_HOURS = "2 hours", 8


def stream_dedup(observations: DataFrame, window: str = LATENESS) -> DataFrame:
    """Observations of a sensor, instant and value once within the watermark.

    Rows without a time or a value go first, so that none stands for the valid one that follows it; another value of the same
    sensor and instant is a correction, and passes.
    """
    return ingest.drop_bad_rows(observations).withWatermark("recorded_at", window).dropDuplicatesWithinWatermark(["sensor_id", "recorded_at", "value"])


def whole_instants(candidates: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The largest canonical value of each monitor, instant and pollutant of a stream, once the watermark has closed the instant.

    An instant's pollutants are closed by the same watermark and so come in one batch, however many pages and runs
    they landed in; repeats and corrections meet in the maximum. What comes later than ``lateness`` is left to the batch jobs.
    """
    marked = candidates.where(ingest.convertible()).withWatermark("recorded_at", lateness)
    return marked.groupBy(*ingest.INSTANT, "pollutant").agg(F.max("canonical_value").alias("canonical_value"), F.max("lat").alias("lat"), F.max("lon").alias("lon"))


def stream_recent(
    spark: SparkSession, landing: str, manifest: str, root: str, checkpoint: str, as_of: datetime | None = None, hours: int = WINDOW_HOURS, user_id: str = "import", lateness: str = LATENESS
) -> StreamingQuery:
    """Load every instant that has closed since the last run, then stop; batches may be empty or come again.

    With ``as_of`` only instants of the ``hours`` before it are loaded. Stations are read when a run starts.
    """
    pages = spark.readStream.schema(files.MEASUREMENTS).json(landing)
    rows = whole_instants(jobs.candidates(jobs.recent_observations(pages, files.read_manifest(spark, manifest))), lateness)

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            jobs.load(serve.filter_since(batch, as_of, hours) if as_of else batch, root, user_id).collect()

    return rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
