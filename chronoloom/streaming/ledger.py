"""Streams of ledger steps: idempotent append, windows and token triggers with state for each key.

Within a key, rows must arrive in order of their sequence number across micro-batches; within one, they
are sorted, and numbers seen already are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.triggers import token_fires


def stream_ledger(stream: DataFrame, path: str, checkpoint: str, watermark: str = "1 day", views: str | None = None) -> StreamingQuery:
    """Appends new events below ``path``, a folder a batch, so that a batch done again replaces itself.

    Below ``views``, each batch also leaves its share of the totals, sha map and progress, for ``ledger_views``; its
    events then have segment_id, seq, original_sha, derived_sha, cost, spec and changelog.
    """
    unique = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if views:
            new = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number}")
            _progress(new).write.mode("overwrite").parquet(f"{views}/progress/batch={number}")
            _lineage(new.select("repo_id", "original_sha", F.struct("ts", "seq", "derived_sha").alias("last"))).write.mode("overwrite").parquet(f"{views}/lineage/batch={number}")

    return unique.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _progress(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("seq", "ts", "spec", "changelog")).alias("last")
    return events.groupBy("repo_id", "segment_id").agg(F.count("*").alias("steps"), F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"), last)


def _lineage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id", "original_sha").agg(F.max("last").alias("last"))


def ledger_views(spark: SparkSession, views: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, sha map, progress) as of the last batch, from the batches' shares; the later step of a sha wins.

    progress is (repo_id, segment_id, steps, spec, changelog, status); a segment with steps is in progress until told otherwise.
    """
    shares = spark.read.parquet(f"{views}/progress")
    totals = shares.groupBy("repo_id").agg(F.sum("steps").alias("total_steps"), F.sum("cost").alias("total_cost"))
    lineage = _lineage(spark.read.parquet(f"{views}/lineage")).select("repo_id", "original_sha", "last.derived_sha")
    progress = shares.groupBy("repo_id", "segment_id").agg(F.sum("steps").alias("steps"), F.max("last").alias("last"))
    return totals, lineage, progress.select("repo_id", "segment_id", "steps", "last.spec", "last.changelog", F.lit("in-progress").alias("status"))


EVENTS = "kind string, repo_id long, segment_id string, epoch long, no long, steps long, micros long, status string, spec string, changelog string, original_sha string, derived_sha string"


def segment_events(stream: DataFrame) -> DataFrame:
    """Rows of ``EVENTS`` from events (repo_id, segment_id, no, kind, status, original_sha, derived_sha, cost, spec, changelog).

    ``no`` numbers the events of a segment; kind is step, status or reset. A first step makes a pending segment in-progress, an
    explicit status stands until another or a reset, and a reset takes back all steps and their costs. The state of a segment
    is its figures and an epoch, the number of its resets, so steps taken back need no list: what a step leaves (``step``) holds
    its epoch, and counts while that is the segment's own. Each batch leaves one ``state`` row for a segment it touches.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, epoch, steps, micros, status, spec, changelog = state.get if state.exists else (-1, 0, 0, 0, "pending", None, None)
        rows = pd.concat(list(frames)).sort_values("no", kind="stable").drop_duplicates("no")
        out = []
        for r in rows[rows["no"] > last].itertuples(index=False):
            last = int(r.no)
            if r.kind == "reset":
                epoch, steps, micros, status, spec, changelog = epoch + 1, 0, 0, "pending", None, None
            elif r.kind == "status":
                status = r.status
            else:
                steps, micros, status = steps + 1, micros + round((r.cost or 0) * 1_000_000), "in-progress" if status == "pending" else status
                spec, changelog = r.spec, r.changelog
                out.append(("step", *key, epoch, last, None, None, None, None, None, r.original_sha, r.derived_sha))
        state.update((last, epoch, steps, micros, status, spec, changelog))
        out.append(("state", *key, epoch, last, steps, micros, status, spec, changelog, None, None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
        yield frame.astype({"steps": "Int64", "micros": "Int64"})

    state = "last long, epoch long, steps long, micros long, status string, spec string, changelog string"
    return stream.groupBy("repo_id", "segment_id").applyInPandasWithState(fold, EVENTS, state, "append", GroupStateTimeout.NoTimeout)


def stream_segments(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``segment_events`` of a stream below ``path``, a folder a batch, so that a batch done again replaces itself; for ``segment_views``."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return segment_events(stream).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def segment_views(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, sha map, progress) as of the last batch: what the batch operators give for the events left after resets.

    The step of the greatest ``no`` wins a commit, of equal ones in two segments the greater sha.
    """
    rows = spark.read.schema(EVENTS).parquet(path)
    latest = rows.where("kind = 'state'").groupBy("repo_id", "segment_id").agg(F.max(F.struct("no", "epoch", "steps", "micros", "status", "spec", "changelog")).alias("s")).select("repo_id", "segment_id", "s.*")
    totals = latest.groupBy("repo_id").agg(F.sum("steps").alias("total_steps"), (F.sum("micros").cast("decimal(28,0)") / 1_000_000).cast("decimal(28,6)").alias("total_cost"))
    steps = rows.where("kind = 'step'").select("repo_id", "segment_id", "epoch", "no", "original_sha", "derived_sha")
    held = steps.join(latest.select("repo_id", "segment_id", "epoch"), ["repo_id", "segment_id", "epoch"], "left_semi")
    mapping = held.groupBy("repo_id", "original_sha").agg(F.max(F.struct("no", "derived_sha"))["derived_sha"].alias("derived_sha"))
    return totals, mapping, latest.select("repo_id", "segment_id", "status", "steps", "spec", "changelog")


def stream_commit_windows(stream: DataFrame, size: int) -> DataFrame:
    """(repo_id, segment_id, ordinal, sha, window): the last ``size`` shas; the state holds size - 1 of them."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1, [])
        rows = pd.concat(list(frames)).sort_values("ordinal").drop_duplicates("ordinal")
        rows = rows[rows["ordinal"] > last]
        window, out = list(held), []
        for sha in rows["sha"]:
            window = [*window, sha][-size:]
            out.append(window)
        if len(rows):
            state.update((int(rows["ordinal"].iloc[-1]), window[-(size - 1) :] if size > 1 else []))
        yield pd.DataFrame({"repo_id": key[0], "segment_id": key[1], "ordinal": rows["ordinal"].to_numpy(), "sha": rows["sha"].to_numpy(), "window": out})

    return stream.groupBy("repo_id", "segment_id").applyInPandasWithState(step, "repo_id long, segment_id string, ordinal long, sha string, window array<string>", "last long, held array<string>", "append", GroupStateTimeout.NoTimeout)


def stream_token_trigger(stream: DataFrame, threshold: int) -> DataFrame:
    """(repo_id, step_no, fires) of the token trigger; the state is the running sum."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values("step_no").drop_duplicates("step_no")
        rows = rows[rows["step_no"] > last]
        fires, total = token_fires(rows["diff_tokens"].tolist(), threshold, total)
        if len(rows):
            state.update((int(rows["step_no"].iloc[-1]), int(total)))
        yield pd.DataFrame({"repo_id": key[0], "step_no": rows["step_no"].to_numpy(), "fires": fires})

    return stream.groupBy("repo_id").applyInPandasWithState(step, "repo_id long, step_no long, fires boolean", "last long, total long", "append", GroupStateTimeout.NoTimeout)
