"""Complete days from hours that arrive in micro-batches, with the late ones kept and merged instead of lost."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.operators import daily
from isotherm.session import delete_staged

HOUR = "cell_key STRING, ts TIMESTAMP, t2m DOUBLE, tp_incr DOUBLE, wind DOUBLE, date DATE"


class DayJob:
    """For ``foreachBatch``: hours into local days, closed once the watermark has passed them.

    The watermark of a batch is the newest local hour of all batches before it, less ``delay``; a day is closed when it
    ends at or before the watermark after a batch. On shared storage under ``path``, one folder per batch, so that a
    batch done twice writes the same folders again:

    * ``hours``: hours of open days, by local date; deleted when the day is closed and the batch is committed
    * ``days``: complete days (24 distinct hours) of the days a batch closed
    * ``partial``: the hours of closed days that were not complete
    * ``late``: hours of days that were closed before their batch came
    * ``ledger``: per batch the newest hour, and the first day still open; a batch counts once it is listed here

    Hours lie in plain rows by date, so neither a cell nor a day gathers anywhere, and what is open is bounded by the delay.
    """

    def __init__(self, spark: SparkSession, path: str, delay: timedelta = timedelta(days=2)):
        self.spark, self.path, self.delay = spark, path.rstrip("/"), delay

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _before(self, batch_id: int) -> tuple[datetime | None, date | None]:
        """Newest local hour of all earlier batches, and the first day they left open."""
        ledger = self._table("ledger", "batch LONG, newest TIMESTAMP_NTZ, open DATE")
        if ledger is None:
            return None, None
        row = ledger.where(F.col("batch") < batch_id).agg(F.max("newest").alias("newest"), F.max("open").alias("open")).first()
        return row["newest"], row["open"]

    def process(self, readings: DataFrame, batch_id: int) -> None:
        """Readings carry ``cell_key``, ``ts``, ``offset_h``, ``t2m``, ``tp_incr`` and ``wind``; a repeated hour counts once."""
        ledger = self._table("ledger", "batch LONG")
        if ledger is not None and not ledger.where(F.col("batch") == batch_id).isEmpty():
            return
        local = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("offset_h"))
        hours = readings.withColumn("local", local).withColumn("date", F.to_date("local")).persist()
        newest, first_open = self._before(batch_id)
        own = hours.agg(F.max("local")).first()[0]
        columns = ["cell_key", F.col("ts").cast("timestamp").alias("ts"), "t2m", "tp_incr", "wind", "date"]
        is_late = F.lit(False) if first_open is None else F.col("date") < F.lit(first_open)
        hours.where(~is_late).select(*columns).write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/hours/batch={batch_id}")
        hours.where(is_late).select(*columns).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        hours.unpersist()
        newest = max((t for t in (newest, own) if t is not None), default=None)
        if newest is None:
            return
        # a day is open while it ends after the watermark
        now_open = (newest - self.delay).date()
        now_open = now_open if first_open is None else max(now_open, first_open)
        closing = self._table("hours", f"{HOUR}, batch LONG").where((F.col("date") < F.lit(now_open)) & (F.col("batch") <= batch_id))
        if first_open is not None:
            closing = closing.where(F.col("date") >= F.lit(first_open))
        self._close(closing, batch_id)
        self.spark.createDataFrame([(batch_id, newest, now_open)], "batch LONG, newest TIMESTAMP_NTZ, open DATE").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch_id}")
        self._drop_closed(now_open)

    def _close(self, hours: DataFrame, batch_id: int) -> None:
        # of a repeated hour the first batch counts
        once = hours.groupBy("cell_key", "date", "ts").agg(F.min_by(F.struct("t2m", "tp_incr", "wind"), "batch").alias("v")).select("cell_key", "date", "ts", "v.*")
        counted = once.groupBy("cell_key", "date").agg(F.count(F.lit(1)).alias("hours"))
        daily.daily_metrics(once.withColumnRenamed("date", "local_date")).drop("hours").write.mode("overwrite").parquet(f"{self.path}/days/batch={batch_id}")
        short = counted.where(F.col("hours") < daily.HOURS_PER_DAY).select("cell_key", "date")
        once.join(short, ["cell_key", "date"], "left_semi").write.mode("overwrite").parquet(f"{self.path}/partial/batch={batch_id}")

    def _drop_closed(self, first_open: date) -> None:
        """Hours of closed days go; they are in ``days`` or ``partial`` now. At most the open span's dates per batch are listed."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        pattern = hadoop.Path(f"{self.path}/hours/batch=*/date=*")
        found = [str(s.getPath()) for s in pattern.getFileSystem(conf).globStatus(pattern)]
        delete_staged(self.spark, [p for p in found if p.rsplit("=", 1)[1] < first_open.isoformat()])

    def days(self) -> DataFrame | None:
        """Days closed in time."""
        return self._table("days", "cell_key STRING, date DATE, tmax_C DOUBLE, tmin_C DOUBLE, precip_mm DOUBLE, wind_max_ms DOUBLE, batch LONG")

    def late_days(self) -> DataFrame | None:
        """Days that are complete now because of late hours: those hours and what ``partial`` kept of the same days."""
        late, partial = self._table("late", f"{HOUR}, batch LONG"), self._table("partial", f"{HOUR}, batch LONG")
        if late is None or partial is None:
            return None
        wanted = late.select("cell_key", "date").distinct()
        # a late hour corrects an hour of a partial day
        both = late.withColumn("_late", F.lit(1)).unionByName(partial.join(wanted, ["cell_key", "date"], "left_semi").withColumn("_late", F.lit(0)))
        once = both.groupBy("cell_key", "date", "ts").agg(F.max_by(F.struct("t2m", "tp_incr", "wind"), "_late").alias("v")).select("cell_key", F.col("date").alias("local_date"), "ts", "v.*")
        return daily.daily_metrics(once).drop("hours")
