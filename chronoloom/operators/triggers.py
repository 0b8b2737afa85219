"""Count- and token-based triggers over ordered steps, and the epochs they cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized
from .folds import folded
from .graph import chase
from .ranges import SIZE, running

R = "repo_id"


def trigger_none(steps: DataFrame) -> DataFrame:
    return steps.withColumn("fires", F.lit(False))


def trigger_every_n(steps: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """Fires at every nth step of a repository; step_no is unique in it."""
    return running(steps, [R], "step_no", {"_done": F.lit(1)}, size=size).withColumn("fires", F.col("_done") % n == 0).drop("_done")


def trigger_every_n_trunk(steps: DataFrame, n: int, compat: bool = False, size: int = SIZE) -> DataFrame:
    """Counts trunk steps and fires on them only.

    ``compat``: the step of the last firing is remembered as a number among all steps, while trunk steps are counted. So with f
    steps of all types up to the last firing, the next firing is at the first trunk step whose trunk number is f + n or more.
    """
    on = F.col("segment_type") == "trunk"
    counted = running(steps, [R], "step_no", {"_trunk": F.when(on, 1).otherwise(0), "_done": F.lit(1)}, size=size)
    if not compat:
        return counted.withColumn("fires", on & (F.col("_trunk") % n == 0)).drop("_trunk", "_done")
    # between trunk steps nothing fires, so the pointers run over trunk steps alone
    steps_on = counted.where(on).select(R, F.col("_trunk").alias("number"), F.col("_done").alias("total"))
    steps_on = materialized(steps_on)
    first = F.lit(n).cast("long")
    starts = steps_on.where(F.col("number") == first).select(R, F.col("number").cast("string").alias("node"))
    target = steps_on.select(R, F.col("number").alias("at"), (F.col("total") + n).alias("number"))
    pointers = target.join(steps_on.select(R, "number"), [R, "number"]).select(R, F.col("at").cast("string").alias("node"), F.col("number").cast("string").alias("next"))
    fired = chase(starts, materialized(pointers)).select(R, F.col("node").cast("long").alias("_trunk"), F.lit(True).alias("_hit"))
    return counted.join(fired, [R, "_trunk"], "left").withColumn("fires", on & F.coalesce("_hit", F.lit(False))).drop("_trunk", "_done", "_hit")


def token_fires(tokens: list[int], threshold: int, total: int = 0) -> tuple[list[bool], int]:
    """The fold itself: a sum that returns to nothing when it reaches the threshold."""
    out = []
    for t in tokens:
        total += t
        out.append(total >= threshold)
        total = 0 if total >= threshold else total
    return out, total


def _next_fires(steps: DataFrame, threshold: int, size: int) -> DataFrame:
    """(repo_id, node, next): for each step, the one that fires next if the sum is nothing after it; step 0 stands before the first.

    Running sums never fall, so the sums of a range of steps, raised by the threshold, lie within few ranges: pairs of ranges that can
    meet come from their ends, and inside one range a window finds the first sum that is large enough.
    """
    sums = running(steps.select(R, "n", "diff_tokens"), [R], "n", {"s": F.col("diff_tokens")}, size=size).select(R, "n", F.col("s").cast("long").alias("s"))
    zero = steps.select(R).distinct().select(R, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    at = materialized(sums.unionByName(zero).withColumn("b", F.floor(F.col("n") / size)))
    ends = at.where("n > 0").groupBy(R, "b").agg(F.max("s").alias("hi"))
    ends = ends.withColumn("lo", F.lag("hi").over(Window.partitionBy(R).orderBy("b")))  # a sum in (lo, hi] is first reached in b
    froms = at.groupBy(R, F.col("b").alias("a")).agg((F.min("s") + threshold).alias("least"), (F.max("s") + threshold).alias("most"))
    pairs = froms.join(ends, R).where("most > coalesce(lo, -1) AND least <= hi").select(R, "a", "b", "lo", "hi")
    asked = at.select(R, F.col("b").alias("a"), "n", (F.col("s") + threshold).alias("s")).join(pairs, [R, "a"]).where("s > coalesce(lo, -1) AND s <= hi")
    rows = asked.select(R, "b", "s", F.col("n").alias("node"), F.lit(None).cast("long").alias("step")).unionByName(at.where("n > 0").select(R, "b", "s", F.lit(None).cast("long").alias("node"), F.col("n").alias("step")))
    after = Window.partitionBy(R, "b").orderBy("s", F.col("node").isNull(), "step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("next", F.first("step", ignorenulls=True).over(after)).where("node IS NOT NULL AND next IS NOT NULL").select(R, "node", "next")


def token_fires_by_pointers(steps: DataFrame, threshold: int, size: int = SIZE) -> DataFrame:
    """``trigger_token_count`` where one repository may have more steps than a task should: pointers to the next firing, then doubling.

    ``threshold`` is positive; a null or negative count of tokens is none.
    """
    clean = steps.withColumn("diff_tokens", F.greatest(F.lit(0), F.coalesce("diff_tokens", F.lit(0))).cast("long"))
    numbered = running(clean, [R], "step_no", {"n": F.lit(1)}, size=size)
    numbered = materialized(numbered.withColumn("n", F.col("n").cast("long")))
    pointers = materialized(_next_fires(numbered, threshold, size))
    fired = chase(numbered.select(R, F.lit(0).cast("long").alias("node")).distinct(), pointers).where("node > 0").select(R, F.col("node").alias("n"), F.lit(True).alias("_hit"))
    return numbered.join(fired, [R, "n"], "left").withColumn("fires", F.coalesce("_hit", F.lit(False))).drop("n", "_hit")


def trigger_token_count(steps: DataFrame, threshold: int, task_steps: int = 5_000_000) -> DataFrame:
    """Fires where the diff tokens since the last firing reach the threshold; equal step numbers go by their tokens.

    Repositories stream through a fold, each in one task; those of more than ``task_steps`` steps go by pointers over all tasks
    instead, to the same result (their step numbers must be unique).
    """
    fold = lambda rows: folded(rows, [R], ["step_no", "diff_tokens"], "diff_tokens", "fires", lambda tokens, total: token_fires(tokens, threshold, total))
    large = steps.where(F.col(R).isNotNull()).groupBy(R).count().where(F.col("count") > task_steps).select(R)
    if threshold <= 0 or large.isEmpty():
        return fold(steps)
    large = materialized(large)
    apart = token_fires_by_pointers(steps.join(large, R, "left_semi"), threshold)
    return fold(steps.join(large, R, "left_anti")).unionByName(apart.select(*steps.columns, "fires"))


def make_trigger(strategy: str = "n-trunk-commits", interval: int = 50) -> Callable[[DataFrame], DataFrame]:
    kinds = {"none": lambda s: trigger_none(s), "n-commits": lambda s: trigger_every_n(s, interval), "n-trunk-commits": lambda s: trigger_every_n_trunk(s, interval), "token-count": lambda s: trigger_token_count(s, interval)}
    if strategy not in kinds:
        raise ValueError(f"unknown strategy: {strategy}")
    return kinds[strategy]


def reconciliation_epochs(fired: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds epoch (firings before this step) and since_sha (the sha of the last one)."""
    rows = running(fired, [R], "step_no", {"_fired": F.when(F.col("fires"), 1).otherwise(0)}, {"since_sha": F.when(F.col("fires"), F.col("original_sha"))}, size)
    return rows.withColumn("epoch", F.col("_fired") - F.when(F.col("fires"), 1).otherwise(0)).drop("_fired")
