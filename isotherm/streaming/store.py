"""The tier store: cell-day tiers on shared storage, changed part by part and never in place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.operators import tiers
from isotherm.session import delete_staged

KEYS = ["cell_key", "date", "tier"]

#: a part of the store, and the micro-batch that wrote its present rows
Part = tuple[str, int, int]


class TierStore:
    """Tiers in parts by tier and hash of the cell; a micro-batch writes the parts it touches and names the rest again.

    ``data/batch=b/tier=t/bucket=k`` holds a part as batch b left it. ``manifests/batch=b`` lists, for each part, the
    batch whose folder is current, which is at most tiers x buckets rows. ``pointer`` gains a row when a manifest is complete, so readers
    see a batch whole or not at all, and a failed batch leaves nothing that is read. A batch at or before the pointer has been done and
    is not done again. Folders that only manifests older than the last ``keep`` name are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep

    # ---- what is there -------------------------------------------------------------------

    def done(self) -> list[int]:
        """Finished batches, the newest last; one row a batch."""
        try:
            rows = self.spark.read.schema("batch LONG").parquet(f"{self.path}/pointer")
            return sorted({r["batch"] for r in rows.sort(F.desc("batch")).limit(self.keep + 2).collect()})
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing written yet

    def manifest(self, batch: int | None = None) -> list[Part]:
        """The current parts as ``(tier, bucket, batch)``, or those of an earlier batch."""
        finished = self.done()
        if not finished:
            return []
        rows = self.spark.read.schema("tier STRING, bucket INT, written LONG").parquet(f"{self.path}/manifests/batch={finished[-1] if batch is None else batch}")
        return sorted((r["tier"], r["bucket"], r["written"]) for r in rows.collect())

    def _folder(self, part: Part) -> str:
        tier, bucket, written = part
        return f"{self.path}/data/batch={written}/tier={tier}/bucket={bucket}"

    def _rows(self, parts: Iterable[Part]) -> DataFrame | None:
        folders = [self._folder(p) for p in parts]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders).drop("batch", "bucket") if folders else None

    def read(self) -> DataFrame | None:
        """All rows as the last finished batch left them."""
        return self._rows(self.manifest())

    # ---- changes -------------------------------------------------------------------------

    def bucket(self, cell: Column) -> Column:
        return F.pmod(F.xxhash64(cell), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame, tier: Column) -> set[tuple[str, int]]:
        """Parts with rows; tiers x buckets at most."""
        return {(r["t"], r["b"]) for r in rows.select(tier.alias("t"), self.bucket(F.col("cell_key")).alias("b")).distinct().collect()}

    def _commit(self, rows: DataFrame, touched: set[tuple[str, int]], batch_id: int) -> None:
        """Write the touched parts anew and move the pointer."""
        data = f"{self.path}/data/batch={batch_id}"
        # ranges, not hashes of the part: a part with most of the rows is several files
        placed = rows.withColumn("bucket", self.bucket(F.col("cell_key"))).repartitionByRange("tier", "bucket", "cell_key", "date").sortWithinPartitions("tier", "bucket", "cell_key", "date")
        placed.write.mode("overwrite").partitionBy("tier", "bucket").parquet(data)
        old = self.manifest()
        # parts that lost their last row have no folder
        schema = "tier STRING, bucket INT"
        left = self.spark.read.schema(f"cell_key STRING, {schema}").parquet(data).select("tier", "bucket").distinct().collect()
        parts = [p for p in old if p[:2] not in touched] + [(r["tier"], r["bucket"], batch_id) for r in left]
        self.spark.createDataFrame(parts, f"{schema}, written LONG").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/batch={batch_id}")
        self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        self._expire()

    def _expire(self) -> None:
        """Delete what only the manifest that just fell out of the last ``keep`` names."""
        finished = self.done()
        if len(finished) <= self.keep:
            return
        dropped = finished[-self.keep - 1]
        named = {p for batch in finished[-self.keep :] for p in self.manifest(batch)}
        try:
            delete_staged(self.spark, [self._folder(p) for p in self.manifest(dropped) if p not in named])
            delete_staged(self.spark, [f"{self.path}/manifests/batch={dropped}"])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise  # an earlier attempt has expired it already

    def _current(self, parts: set[tuple[str, int]]) -> DataFrame | None:
        return self._rows(p for p in self.manifest() if p[:2] in parts)

    def _is_done(self, batch_id: int) -> bool:
        finished = self.done()
        return bool(finished) and batch_id <= finished[-1]

    def refresh(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: recent days by date, forecasts whole, and the archive supersedes recent days.

        Rows carry ``tier``; ``seq`` orders rows of the same cell and day within a batch. A day that the archive has is
        never kept as recent, whichever came first.
        """
        if self._is_done(batch_id):
            return
        new = tiers.dedupe_last(batch, KEYS, "seq").drop("seq").persist()
        touched = self._touched(new, F.col("tier"))
        archive_buckets = {("archive", b) for t, b in touched if t == "recent"}
        # a new archive day can only push out recent days of its own bucket
        touched |= {("recent", b) for t, b in touched if t == "archive"}
        old = self._current(touched)
        archived = new.where("tier = 'archive'").select("cell_key", "date")
        if (known := self._current(archive_buckets)) is not None:
            archived = archived.unionByName(known.select("cell_key", "date"))
        rows = new
        if old is not None:
            refreshed = new.where("tier = 'forecast'").select("cell_key").distinct()
            kept = old.where("tier <> 'forecast'").unionByName(old.where("tier = 'forecast'").join(refreshed, "cell_key", "left_anti"))
            rows = tiers.upsert_by_date(kept, new, KEYS)
        superseded = archived.distinct().withColumn("tier", F.lit("recent"))
        self._commit(rows.join(superseded, KEYS, "left_anti"), touched, batch_id)
        new.unpersist()

    def merge_late(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: new values win column by column; no day is ever lost."""
        if self._is_done(batch_id):
            return
        new = tiers.dedupe_last(batch, KEYS, "seq").drop("seq").persist()
        touched = self._touched(new, F.col("tier"))
        old = self._current(touched)
        self._commit(new if old is None else tiers.merge_columns(old, new, KEYS), touched, batch_id)
        new.unpersist()


class AppendLog:
    """Rows appended micro-batch by micro-batch, each batch once: its folder carries its number, so a batch that comes again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. Only complete folders are read: the overwritten one gets its files when all tasks are done."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")
