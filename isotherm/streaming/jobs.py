"""Structured Streaming jobs: complete days, tier refresh, hits and sessions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isotherm.operators.daily import HOURS_PER_DAY, to_daily_units
from isotherm.operators.tiers import FRONTIER_DAYS

#: 2^12 registers: one standard error is 1.6 %, and a few hundred visitors are counted exactly
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
GRAINS = ("10 minutes", "hour", "day")


def complete_days(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """Local days from an hourly stream, emitted once the watermark has passed them.

    Readings carry ``cell_key``, ``ts``, ``offset_h``, ``t2m``, ``tp_incr`` and ``wind``.
    Only days with all 24 hours come out; hours later than the watermark are lost here (``days.DayJob`` keeps them).
    A repeated hour counts once.
    """
    local = (
        readings.withColumn("local_ts", F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.col("offset_h")))
        .withWatermark("local_ts", late)
        .dropDuplicatesWithinWatermark(["cell_key", "ts"])
    )
    daily = local.groupBy(F.window("local_ts", "1 day").alias("_w"), "cell_key").agg(
        F.max("t2m").alias("_hi"), F.min("t2m").alias("_lo"), F.sum("tp_incr").alias("_rain"), F.max("wind").alias("_wind"), F.count(F.lit(1)).alias("hours")
    )
    return daily.where(F.col("hours") == HOURS_PER_DAY).select("cell_key", F.to_date("_w.start").alias("date"), *to_daily_units())


def hit_buckets(hits: DataFrame, bucket: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Hits per bucket and country, and a sketch of their visitors that can be merged over buckets."""
    return (
        hits.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", bucket).alias("_w"), "country")
        .agg(F.count(F.lit(1)).alias("hits"), F.hll_sketch_agg("visitor", SKETCH_BITS).alias("sketch"))
        .select(F.col("_w.start").alias("bucket"), "country", "hits", "sketch")
    )


def _grain_start(bucket: Column, grain: str) -> Column:
    return bucket if grain == GRAINS[0] else F.date_trunc(grain, bucket)


def people_rollup(buckets: DataFrame) -> DataFrame:
    """Hits and people per grain, start and country, from the finest buckets alone: a visitor of two buckets is one person.

    The error of ``people`` is that of the merged sketch, ``SKETCH_ERROR`` at any grain.
    """
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), _grain_start(F.col("bucket"), g).alias("start")) for g in GRAINS])).alias("_g")
    return (
        buckets.select(grains, "country", "hits", "sketch")
        .groupBy("_g.grain", "_g.start", "country")
        .agg(F.sum("hits").alias("hits"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("people"))
    )


def people_exact(hits: DataFrame) -> DataFrame:
    """The batch twin of ``people_rollup``: distinct visitors, counted."""
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), _grain_start(F.col("_w.start"), g).alias("start")) for g in GRAINS])).alias("_g")
    return (
        hits.withColumn("_w", F.window(F.col("ts").cast("timestamp"), GRAINS[0]))
        .select(grains, "country", "visitor")
        .groupBy("_g.grain", "_g.start", "country", "visitor")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("grain", "start", "country")
        .agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("people"))
    )


def visitor_sessions(hits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Finished browsing sessions: first and last hit, and hits. The state is a few numbers per open session."""
    return (
        hits.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("_s"), "visitor")
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("hits"))
        .select("visitor", "start", "end", "hits")
    )


def slot_pages(hits: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each page of a visitor once per slot of one gap's length.

    Hits of one slot are less than a gap apart, so a slot belongs to one session. The state is a row per visitor, slot and page, dealt out by
    all three: a crawler's pages lie in many rows and tasks, and go when the slot does.
    """
    return (
        hits.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", gap).alias("_w"), "visitor", "page")
        .agg(F.count(F.lit(1)).alias("hits"))
        .select("visitor", F.col("_w.start").alias("slot"), "page", "hits")
    )


def count_pages(sessions: DataFrame, pages: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Finished sessions with their distinct pages, from the slots they touch; equi-joins and two aggregations."""
    first = sessions.select("visitor", "start", F.window("start", gap).start.alias("_a"), "end")
    last = first.select("visitor", "start", "_a", F.window("end", gap).start.alias("_b"))
    touched = last.select("visitor", "start", F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {gap}"))).alias("slot"))
    distinct = touched.join(pages.select("visitor", "slot", "page"), ["visitor", "slot"]).groupBy("visitor", "start", "page").agg(F.lit(1).alias("_one"))
    counted = distinct.groupBy("visitor", "start").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    return sessions.join(counted, ["visitor", "start"])


def unique_events(events: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def pending_work(wanted: DataFrame, ledger: DataFrame, signature: str) -> DataFrame:
    """Cell spans that a run under this signature has not finished."""
    done = ledger.where(F.col("signature") == signature).select("cell_key", "first_year", "last_year")
    return wanted.join(done, ["cell_key", "first_year", "last_year"], "left_anti")


def expired_tiers(updates: DataFrame, ttl_hours: dict[str, int]) -> DataFrame:
    """Live staleness: one row whenever a cell's tier outlives its limit without an update.

    ``updates`` carry ``cell_key``, ``tier``, ``updated_ms`` and a watermarked ``ts``. The
    state is one number per cell and tier.
    """
    limits = {tier: hours * 3_600_000 for tier, hours in ttl_hours.items()}

    def watch(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cell, tier = key
        if state.hasTimedOut:
            due = state.get[0] + limits[tier]
            state.remove()
            yield pd.DataFrame({"cell_key": [cell], "tier": [tier], "expired_ms": [due]})
            return
        newest = max(int(frame["updated_ms"].max()) for frame in frames)
        if state.exists:
            newest = max(newest, state.get[0])
        due = newest + limits[tier]
        if due <= state.getCurrentWatermarkMs():
            yield pd.DataFrame({"cell_key": [cell], "tier": [tier], "expired_ms": [due]})
        else:
            state.update((newest,))
            state.setTimeoutTimestamp(due)

    return updates.groupBy("cell_key", "tier").applyInPandasWithState(
        watch, "cell_key STRING, tier STRING, expired_ms LONG", "updated_ms LONG", "append", GroupStateTimeout.EventTimeTimeout
    )


DAY_MS = 86_400_000


class Seam(NamedTuple):
    """What a cell's state holds of its recent tier: the archive's last day, the newest update, and the runs of present days after
    the archive as two lists of days since 1970. The days missing lie between the runs, so a state is as long as it has holes."""

    archive_end: int
    updated_ms: int
    starts: list[int]
    ends: list[int]
    asked: str

    def with_days(self, archive: list[int], recent: list[int], updated_ms: int) -> Seam:
        end = max([self.archive_end, *archive])
        runs: list[list[int]] = []
        for first, last in sorted([*zip(self.starts, self.ends), *((d, d) for d in recent)]):
            if last <= end:
                continue
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([max(first, end + 1), last])
        return Seam(end, max(self.updated_ms, updated_ms), [r[0] for r in runs], [r[1] for r in runs], "")

    def first_missing(self) -> int:
        after = self.archive_end + 1
        return self.ends[0] + 1 if self.starts and self.starts[0] == after else after

    def next_ask(self, ttl_ms: int, frontier_days: int) -> tuple[int, str] | None:
        """When to ask for a refresh, and why; a tail that was asked for in vain is asked for again when it is a hole."""
        missing = self.first_missing()
        heal, extend = (missing + frontier_days) * DAY_MS, max(self.updated_ms + ttl_ms, missing * DAY_MS)
        if self.asked == "heal":
            return None
        return (heal, "heal") if heal <= extend or self.asked == "extend" else (extend, "extend")


def recent_decisions(updates: DataFrame, ttl_hours: int = 24, frontier_days: int = FRONTIER_DAYS) -> DataFrame:
    """The live twin of ``tiers.heal_rule``: a row whenever a cell's recent tier falls due, by event-time timers.

    ``updates`` carry ``cell_key``, ``tier`` (archive or recent), ``date``, ``updated_ms`` and a watermarked ``ts``. An old
    hole is asked for at once, whatever the age of the tier; the tail when the age allows; nothing without an archive.
    """
    ttl_ms, none = ttl_hours * 3_600_000, -(1 << 30)
    epoch = pd.Timestamp("1970-01-01").date()

    def watch(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seam = Seam(*state.get) if state.exists else Seam(none, 0, [], [], "")
        if not state.hasTimedOut:
            archive, recent, newest = [], [], 0
            for frame in frames:
                days = [(d - epoch).days for d in frame["date"]]
                archive += [d for d, t in zip(days, frame["tier"]) if t == "archive"]
                recent += [d for d, t in zip(days, frame["tier"]) if t == "recent"]
                ours = frame.loc[frame["tier"] == "recent", "updated_ms"]
                newest = max(newest, int(ours.max()) if len(ours) else 0)
            seam = seam.with_days(archive, recent, newest)
        out = []
        if seam.archive_end > none and seam.updated_ms:
            now = state.getCurrentWatermarkMs()
            while (ask := seam.next_ask(ttl_ms, frontier_days)) is not None and ask[0] <= now:
                out.append((key[0], epoch + dt.timedelta(days=seam.first_missing()), ask[1], ask[0]))
                seam = seam._replace(asked=ask[1])
            state.update(tuple(seam))
            if ask is not None:
                state.setTimeoutTimestamp(ask[0])
        else:
            state.update(tuple(seam))
        yield pd.DataFrame(out, columns=["cell_key", "first_missing", "reason", "due_ms"])

    return updates.groupBy("cell_key").applyInPandasWithState(
        watch, "cell_key STRING, first_missing DATE, reason STRING, due_ms LONG", "archive_end INT, updated_ms LONG, starts ARRAY<INT>, ends ARRAY<INT>, asked STRING", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
