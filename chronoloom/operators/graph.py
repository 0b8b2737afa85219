"""Commit graph: edges, trunk, segments, dependencies, closures and orders.

Walks along a chain of a large repository use pointer doubling: n commits take log2(n) equi-joins on (repo_id, sha), and the
repository spreads over all tasks. Small repositories, however many, are walked inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialized, released
from .longest import longest_paths
from .ranges import running

R = "repo_id"


def numbered(commits: DataFrame, keep: list[str]) -> DataFrame:
    """(repo_id, log_pos, sha, parents, *keep) with the log position of a commit for its sha; a parent outside the table is null.

    All that follows edges works on either; numbers take a tenth of the room. ``keep``: columns that one commit has one value of.
    """
    links = commits.select(R, "log_pos", *keep, F.posexplode_outer("parents").alias("o", "parent"))
    at = commits.select(R, F.col("sha").alias("parent"), F.col("log_pos").alias("at"))
    found = links.join(at, [R, "parent"], "left").groupBy(R, "log_pos", *keep).agg(F.array_sort(F.collect_list(F.when(F.col("o").isNotNull(), F.struct("o", "at")))).alias("l"))
    return found.select(R, "log_pos", F.col("log_pos").alias("sha"), F.col("l.at").alias("parents"), *keep)


def commit_edges(commits: DataFrame) -> DataFrame:
    """(repo_id, child, parent, parent_ord, child_log_pos); parents outside the table give no edge."""
    edges = commits.select(R, F.col("sha").alias("child"), F.posexplode("parents").alias("parent_ord", "parent"), F.col("log_pos").alias("child_log_pos"))
    return edges.join(commits.select(R, F.col("sha").alias("parent")), [R, "parent"], "left_semi").select(R, "child", "parent", "parent_ord", "child_log_pos")


def with_children(commits: DataFrame) -> DataFrame:
    """Commits with their children, newest first."""
    lists = commit_edges(commits).groupBy(R, F.col("parent").alias("sha")).agg(F.array_sort(F.collect_list(F.struct("child_log_pos", "child"))).alias("c"))
    empty = F.array().cast("array<string>")
    return commits.join(lists, [R, "sha"], "left").withColumn("children", F.coalesce(F.col("c.child"), empty)).drop("c")


def roots_merges_leaves(commits: DataFrame) -> DataFrame:
    """(repo_id, sha, is_root, is_merge, is_leaf) of every commit."""
    parents = commit_edges(commits).select(R, F.col("parent").alias("sha"), F.lit(True).alias("inner")).distinct()
    return commits.join(parents, [R, "sha"], "left").select(R, "sha", (F.size("parents") == 0).alias("is_root"), (F.size("parents") > 1).alias("is_merge"), F.col("inner").isNull().alias("is_leaf"))


def first_root(commits: DataFrame) -> DataFrame:
    """The root that comes first in log order; repositories without a root give no row."""
    return commits.where(F.size("parents") == 0).groupBy(R).agg(F.min_by("sha", "log_pos").alias("sha"))


#: Pointers of a repository that are followed inside a task; more go by doubling over all tasks.
TASK_POINTERS = 200_000


def chase(starts: DataFrame, pointers: DataFrame, task_pointers: int | None = None) -> DataFrame:
    """All (repo_id, start, node, hop) that following ``pointers`` (repo_id, node, next) from ``starts`` reaches.

    Repositories of at most ``task_pointers`` are followed side by side, each in a task that sorted rows stream through; larger ones by
    doubling, each over all tasks, to the same rows. Raises ValueError if the pointers have a cycle: no chain is longer than there
    are pointers.
    """
    most = TASK_POINTERS if task_pointers is None else task_pointers
    large = materialized(pointers.groupBy(R).count().where(F.col("count") > most).select(R))
    some, none = not large.isEmpty(), {"how": "left_anti", "on": R}
    try:
        near = materialized(_followed(starts.join(large, **none) if some else starts, pointers.join(large, **none) if some else pointers))
    except PythonException as e:
        if "has a cycle" in str(e):
            raise ValueError("the history has a cycle") from e
        raise
    return near.unionByName(_doubled(starts.join(large, R, "left_semi"), pointers.join(large, R, "left_semi"))) if some else near


def _followed(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """``chase`` inside tasks: a repository's pointers are held by one task at a time."""
    kind = pointers.schema["node"].dataType
    none = F.lit(None).cast(kind)
    rows = pointers.select(R, F.lit(0).alias("kind"), "node", "next").unionByName(starts.select(R, F.lit(1).alias("kind"), F.col("node").cast(kind), none.alias("next")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ahead = None, {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for repo, what, node, after in zip(*[c.to_pylist() for c in batch.columns]):
                if repo != now:
                    now, ahead = repo, {}
                if what == 0:
                    ahead[node] = after
                    continue
                at, hop = node, 0
                while at is not None:
                    if hop > len(ahead):
                        raise ValueError("the history has a cycle")
                    for column, value in zip(out, (repo, node, at, hop)):
                        column.append(value)
                    at, hop = ahead.get(at), hop + 1
            types = (batch.schema.field(0).type, batch.schema.field(2).type, batch.schema.field(2).type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [R, "start", "node", "hop"])

    schema = T.StructType([pointers.schema[R], *[T.StructField(c, kind) for c in ("start", "node")], T.StructField("hop", T.LongType())])
    return rows.repartition(R).sortWithinPartitions(R, "kind").mapInArrow(run, schema)


def _doubled(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """``chase`` by pointer doubling; a round is one job and writes only what it finds."""
    first = starts.select(R, F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("hop")).distinct()
    parts = [materialized(first)]
    jump, step, longest = pointers.select(R, "node", "next"), 1, None
    while True:
        if step >= 64:
            longest = pointers.count() if longest is None else longest
            if step > 2 * longest:
                raise ValueError("the history has a cycle")
        reach = reduce(DataFrame.unionByName, parts)
        found = reach.join(jump, [R, "node"]).select(R, "start", F.col("next").alias("node"), (F.col("hop") + step).alias("hop"))
        ahead = jump.select(R, F.col("node").alias("next"), F.col("next").alias("far"))
        farther = jump.join(ahead, [R, "next"]).select(R, F.lit(None).cast(found.schema["start"].dataType).alias("start"), "node", F.lit(None).cast("long").alias("hop"), F.col("far").alias("next"))
        both = materialized(found.withColumn("next", F.lit(None).cast(jump.schema["next"].dataType)).unionByName(farther))  # a round is one job
        parts.append(both.where("hop IS NOT NULL").drop("next"))
        jump, step = both.where("next IS NOT NULL").select(R, "node", "next"), step * 2
        if jump.isEmpty():
            out = materialized(reduce(DataFrame.unionByName, parts))  # without the pointers of all rounds
            released(*parts)
            return out


def mark_trunk(commits: DataFrame, refs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(repo_id, sha, depth_from_tip) of the first-parent walk from each ref; it ends at a parent outside the table.

    ``edges``: the ``commit_edges`` of ``commits``, where they are already a table.
    """
    first = (commit_edges(commits) if edges is None else edges).where("parent_ord = 0").select(R, F.col("child").alias("node"), F.col("parent").alias("next"))
    tips = refs.join(commits.select(R, "sha"), [R, "sha"], "left_semi").select(R, F.col("sha").alias("node"))
    held = materialized(first) if edges is None else first
    walk = chase(tips, held).select(R, F.col("node").alias("sha"), F.col("hop").alias("depth_from_tip"))
    if edges is None:
        released(held)
    return walk


def missing_refs(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """Refs that name no commit of the table: an error for the caller to raise."""
    return refs.join(commits.select(R, "sha"), [R, "sha"], "left_anti")


def _marked(edges: DataFrame, trunk: DataFrame, end: str) -> DataFrame:
    """Adds child_on or parent_on: whether that end of an edge is on the trunk."""
    on = trunk.select(R, F.col("sha").alias(end), F.lit(True).alias(f"{end}_on")).distinct()
    return edges.join(on, [R, end], "left").withColumn(f"{end}_on", F.coalesce(f"{end}_on", F.lit(False)))


def _trunk_edges(edges: DataFrame, trunk: DataFrame) -> DataFrame:
    """(repo_id, child, parent, child_log_pos, child_on, parent_on); each join's shuffle is gone before the next one's."""
    half = materialized(_marked(edges.select(R, "child", "parent", "child_log_pos"), trunk, "child"))
    both = materialized(_marked(half, trunk, "parent"))
    released(half)
    return both


def trunk_path(commits: DataFrame, trunk: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(repo_id, sha, trunk_pos) from the first trunk root along first trunk children in log order.

    ``marked``: the edges and which of their ends are on the trunk, where they are already a table.
    """
    rows = _trunk_edges(commit_edges(commits), trunk) if marked is None else marked
    inside = rows.where("child_on AND parent_on")
    following = materialized(inside.groupBy(R, F.col("parent").alias("node")).agg(F.min_by("child", "child_log_pos").alias("next")))
    roots = first_root(commits.join(trunk.select(R, "sha"), [R, "sha"], "left_semi")).select(R, F.col("sha").alias("node"))
    walk = chase(roots, following).select(R, F.col("node").alias("sha"), F.col("hop").alias("trunk_pos"))
    released(following, *([rows] if marked is None else []))
    return walk


def trunk_segments(path: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, segment_id, ordinal, sha, trunk_pos): the trunk, cut before every merge but at the first row.

    Numbers come from ranges of trunk_pos, so that one long trunk spreads over all tasks.
    """
    rows = path.join(commits.select(R, "sha", (F.size("parents") > 1).alias("merge")), [R, "sha"])
    cut = F.col("merge") & (F.col("trunk_pos") > 0)
    rows = running(rows, [R], "trunk_pos", {"k": F.when(cut, 1).otherwise(0)}, {"last": F.when(cut, F.col("trunk_pos"))})
    begins = F.when(cut, F.col("trunk_pos")).otherwise(F.coalesce("last", F.lit(0)))
    return rows.select(R, F.concat(F.lit("trunk-"), "k").alias("segment_id"), (F.col("trunk_pos") - begins).alias("ordinal"), "sha", "trunk_pos")


def branch_segments(commits: DataFrame, trunk: DataFrame, path: DataFrame, marked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, segment_commits) of the traces off the trunk: branches that merge back, and dead ends; ``marked`` as in ``trunk_path``."""
    rows = _trunk_edges(commit_edges(commits), trunk) if marked is None else marked
    flags = rows.where("NOT (child_on AND parent_on)").withColumnRenamed("child_on", "on")
    steps = materialized(flags.where("NOT parent_on").groupBy(R, F.col("parent").alias("node")).agg(F.min_by(F.when(F.col("on"), F.col("child")), F.when(F.col("on"), F.col("child_log_pos"))).alias("merges_into"), F.min_by(F.when(~F.col("on"), F.col("child")), F.when(~F.col("on"), F.col("child_log_pos"))).alias("next")))
    starts = flags.where("NOT on AND parent_on").join(path.select(R, F.col("sha").alias("parent"), "trunk_pos"), [R, "parent"]).select(R, F.col("child").alias("start"), F.col("parent").alias("fork_from"), "trunk_pos", "child_log_pos")
    starts = materialized(starts)
    reach = chase(starts.select(R, F.col("start").alias("node")), steps.where("merges_into IS NULL AND next IS NOT NULL").select(R, "node", "next"))
    ends = reach.join(steps.select(R, "node", "merges_into"), [R, "node"], "left").groupBy(R, "start").agg(F.max("merges_into").alias("merges_into"), F.count("*").alias("n_commits"))
    found = starts.join(ends, [R, "start"]).withColumn("type", F.when(F.col("merges_into").isNotNull(), "branch").otherwise("dead-end"))
    number = F.row_number().over(Window.partitionBy(R, "type").orderBy("trunk_pos", "child_log_pos")) - 1
    order = F.row_number().over(Window.partitionBy(R).orderBy("trunk_pos", "child_log_pos")) - 1
    segments = materialized(found.withColumn("segment_id", F.concat_ws("-", "type", number)).withColumn("branch_ord", order))
    released(steps, starts, *([rows] if marked is None else []))
    members = reach.join(segments.select(R, "start", "segment_id"), [R, "start"]).select(R, "segment_id", F.col("hop").alias("ordinal"), F.col("node").alias("sha"))
    return segments.select(R, "segment_id", "type", "branch_ord", "fork_from", "merges_into", "n_commits"), members


def decompose(commits: DataFrame, refs: DataFrame) -> dict[str, DataFrame]:
    """trunk, path, segments and segment_commits of all repositories, each written once."""
    edges = materialized(commit_edges(commits))
    trunk = mark_trunk(commits, refs, edges)
    marked = _trunk_edges(edges, trunk)
    released(edges)
    path = trunk_path(commits, trunk, marked)
    on = materialized(trunk_segments(path, commits))
    branches, members = branch_segments(commits, trunk, path, marked)
    released(marked)
    heads = on.groupBy(R, "segment_id").agg(F.count("*").alias("n_commits"), F.min("trunk_pos").alias("at")).withColumn("creation_ord", F.row_number().over(Window.partitionBy(R).orderBy("at")) - 1)
    counts = heads.groupBy(R).agg(F.count("*").alias("n"))
    none = F.lit(None).cast(commits.schema["sha"].dataType)
    segments = heads.select(R, "segment_id", F.lit("trunk").alias("type"), F.col("creation_ord").cast("long"), none.alias("fork_from"), none.alias("merges_into"), "n_commits").unionByName(
        branches.join(counts, R).select(R, "segment_id", "type", (F.col("branch_ord") + F.col("n")).cast("long").alias("creation_ord"), "fork_from", "merges_into", "n_commits")
    )
    out = {"trunk": trunk, "path": path, "segments": materialized(segments), "segment_commits": materialized(on.select(R, "segment_id", F.col("ordinal").cast("long"), "sha").unionByName(members))}
    released(on, branches, members)
    return out


def commit_owner(segment_commits: DataFrame, segments: DataFrame) -> DataFrame:
    """(repo_id, sha, segment_id): the last created segment that holds a commit."""
    rows = segment_commits.join(segments.select(R, "segment_id", "creation_ord"), [R, "segment_id"])
    return rows.groupBy(R, "sha").agg(F.max_by("segment_id", "creation_ord").alias("segment_id"))


def segment_deps(commits: DataFrame, segments: DataFrame, segment_commits: DataFrame) -> DataFrame:
    """(repo_id, segment_id, dep_ord, dep_id): trunk segments need the owners of their first parents, others that of the fork."""
    owner = commit_owner(segment_commits, segments).select(R, F.col("sha").alias("parent"), F.col("segment_id").alias("dep_id"))
    first = segment_commits.where("ordinal = 0").join(segments.where("type = 'trunk'").select(R, "segment_id"), [R, "segment_id"]).join(commits.select(R, "sha", "parents"), [R, "sha"])
    wanted = first.select(R, "segment_id", F.posexplode("parents").alias("o", "parent")).unionByName(segments.where("fork_from IS NOT NULL").select(R, "segment_id", F.lit(0).alias("o"), F.col("fork_from").alias("parent")))
    found = wanted.join(owner, [R, "parent"]).where("dep_id <> segment_id").groupBy(R, "segment_id", "dep_id").agg(F.min("o").alias("o"))
    return found.select(R, "segment_id", (F.row_number().over(Window.partitionBy(R, "segment_id").orderBy("o")) - 1).alias("dep_ord"), "dep_id")


def _distances(segments: DataFrame, deps: DataFrame, weight: Column) -> DataFrame:
    """(repo_id, segment_id, dist): weight plus the largest dist of the dependencies.

    Segments off the trunk that need one trunk segment at most are edges between trunk segments first, so that what is
    solved is the trunk, in its order. Raises ValueError if dependencies have a cycle.
    """
    rows = segments.select(R, "segment_id", "type", F.col("creation_ord").alias("pos"), weight.cast("long").alias("w"))
    known = deps.select(R, "segment_id", "dep_id").distinct().join(rows.select(R, F.col("segment_id").alias("dep_id"), (F.col("type") == "trunk").alias("on")), [R, "dep_id"])
    needs = known.groupBy(R, "segment_id").agg(F.count("*").alias("n"), F.bool_and("on").alias("on"), F.min("dep_id").alias("dep_id"))
    rows = rows.join(needs, [R, "segment_id"], "left")
    rows = materialized(rows.withColumn("edge", (F.col("type") != "trunk") & ((F.coalesce("n", F.lit(0)) == 0) | ((F.col("n") == 1) & F.col("on")))))
    side = rows.where("edge").select(R, F.col("segment_id").alias("dep_id"), F.col("dep_id").alias("src"), F.col("w").alias("side"))
    links = known.join(rows.where("NOT edge").select(R, "segment_id"), [R, "segment_id"], "left_semi").join(side, [R, "dep_id"], "left")
    links = materialized(links.select(R, F.when(F.col("side").isNull(), F.col("dep_id")).otherwise(F.col("src")).alias("src"), F.col("segment_id").alias("dst"), F.coalesce("side", F.lit(0)).alias("gain")))
    base = links.where("src IS NULL").groupBy(R, F.col("dst").alias("segment_id")).agg(F.max("gain").alias("base"))
    nodes = rows.where("NOT edge").join(base, [R, "segment_id"], "left").select(R, F.col("segment_id").alias("node"), "pos", "w", F.coalesce("base", F.lit(0)).alias("base"))
    try:
        found = longest_paths(nodes, links.where("src IS NOT NULL")).withColumnRenamed("node", "segment_id")
    except PythonException as e:
        if "have a cycle" in str(e):
            raise ValueError("the dependencies have a cycle") from e
        raise
    below = found.select(R, F.col("segment_id").alias("dep_id"), F.col("dist").alias("before"))
    return found.unionByName(rows.where("edge").join(below, [R, "dep_id"], "left").select(R, "segment_id", (F.col("w") + F.coalesce("before", F.lit(0))).alias("dist")))


def segment_levels(segments: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo_id, segment_id, level): the longest chain of dependencies below a segment."""
    return _distances(segments, deps, F.lit(1)).select(R, "segment_id", (F.col("dist") - 1).alias("level"))


def segment_topo_order(segments: DataFrame, deps: DataFrame) -> DataFrame:
    """Adds topo_pos: by level, then creation order; dependencies always come first."""
    rows = segments.join(segment_levels(segments, deps), [R, "segment_id"])
    return rows.withColumn("topo_pos", F.row_number().over(Window.partitionBy(R).orderBy("level", "creation_ord")) - 1)


def segment_post_order(segments: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo_id, segment_id, post_pos): depth-first post-order, roots in creation order and dependencies in theirs (dep_ord).

    The order of a search is sequential; a task holds the segments (not commits) of one repository. Unknown dependencies
    are passed over; one that is still being visited, in a cycle, isn't entered again.
    """

    def search(key, rows: pd.DataFrame) -> pd.DataFrame:
        needs = {r.segment_id: [d["dep_id"] for d in r.needs] for r in rows.sort_values("creation_ord").itertuples()}
        order, seen = [], set()
        for root in needs:
            if root in seen:
                continue
            seen.add(root)
            path = [(root, iter(needs[root]))]
            while path:
                node, left = path[-1]
                below = next((d for d in left if d in needs and d not in seen), None)
                if below is None:
                    order.append(node)
                    path.pop()
                else:
                    seen.add(below)
                    path.append((below, iter(needs[below])))
        return pd.DataFrame({R: key[0], "segment_id": order, "post_pos": range(len(order))})

    lists = deps.groupBy(R, "segment_id").agg(F.array_sort(F.collect_list(F.struct("dep_ord", "dep_id"))).alias("needs"))
    none = F.array().cast(lists.schema["needs"].dataType)
    rows = segments.select(R, "segment_id", "creation_ord").join(lists, [R, "segment_id"], "left").withColumn("needs", F.coalesce("needs", none))
    return rows.groupBy(R).applyInPandas(search, f"{R} {segments.schema[R].dataType.simpleString()}, segment_id string, post_pos long")


def critical_path(segments: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo_id, critical_path): the heaviest dependency chain by commit count; unknown dependencies weigh nothing."""
    return _distances(segments, deps, F.col("n_commits")).groupBy(R).agg(F.max("dist").alias("critical_path"))


def commit_chains(commits: DataFrame, trunk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, crossings): (repo_id, sha, chain, place) of every commit, and the edges between chains.

    A chain runs along first parents, and of the children of a commit only one carries its chain on, the one on ``trunk``
    (repo_id, sha) or else the newest; so every commit is in one chain and a trunk isn't cut. crossings are (repo_id, chain, place, to_chain, to_place): all other edges to commits of the table.
    Commits on a cycle of first parents are in no chain; a history has none.
    """
    on = trunk.select(R, F.col("sha").alias("child"), F.lit(True).alias("on")).distinct()
    edges = materialized(commit_edges(commits))
    first = edges.where("parent_ord = 0").join(on, [R, "child"], "left")
    carried = first.groupBy(R, "parent").agg(F.min_by("child", F.struct(F.col("on").isNull(), "child_log_pos")).alias("child"))
    carried = materialized(carried.select(R, F.col("child").alias("node"), F.col("parent").alias("next")))
    # a commit has one first edge, carried if the commit is a node of carried
    goes_on = carried.select(R, F.col("node").alias("child"), F.lit(True).alias("carried"))
    other = materialized(edges.join(goes_on, [R, "child"], "left").where("parent_ord <> 0 OR carried IS NULL").select(R, "child", "parent"))
    released(edges)
    heads = materialized(commits.select(R, F.col("sha").alias("node")).join(carried.select(R, F.col("next").alias("node")), [R, "node"], "left_anti"))
    chains = chase(heads, carried).select(R, F.col("node").alias("sha"), F.col("start").alias("chain"), F.col("hop").alias("place"))
    released(carried, heads)
    one = chains.select(R, F.col("sha").alias("child"), "chain", "place")
    two = chains.select(R, F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    crossings = materialized(other.join(one, [R, "child"]).join(two, [R, "parent"]).select(R, "chain", "place", "to_chain", "to_place"))
    released(other)
    return chains, crossings


def ancestors(commits: DataFrame, starts: DataFrame, trunk: DataFrame | None = None) -> DataFrame:
    """(repo_id, sha) of the starts, present or not, and of all parents that edges reach, present or not.

    Reaching a place of a chain reaches all that follow it, so a round is a step between chains, not a generation, and what is
    kept is a place a chain. ``trunk``: commits that are to stay one chain; else the first-parent walk of each repository's newest start.
    Cyclic input ends like other input, or with a ValueError where first parents have a cycle.
    """
    walked = None
    if trunk is None:
        newest = commits.join(starts.select(R, "sha").distinct(), [R, "sha"], "left_semi").groupBy(R).agg(F.min_by("sha", "log_pos").alias("sha"))
        walked = trunk = mark_trunk(commits, newest)
    placed, crossings = commit_chains(commits, trunk)
    if walked is not None:
        released(walked)
    front = placed.join(starts.select(R, "sha").distinct(), [R, "sha"], "left_semi").groupBy(R, "chain").agg(F.min("place").alias("place"))
    front = materialized(front.withColumn("before", F.lit(None).cast("long")))
    rounds = [front]
    while True:
        from_here = front.select(R, "chain", F.col("place").alias("least"), "before")
        into = crossings.join(from_here, [R, "chain"]).where("place >= least AND (before IS NULL OR place < before)").groupBy(R, F.col("to_chain").alias("chain")).agg(F.min("to_place").alias("place"))
        known = reduce(DataFrame.unionByName, rounds).groupBy(R, "chain").agg(F.min("place").alias("before"))
        front = materialized(into.join(known, [R, "chain"], "left").where("before IS NULL OR place < before").select(R, "chain", "place", "before"))
        if front.isEmpty():
            break
        rounds.append(front)
    least = reduce(DataFrame.unionByName, rounds).groupBy(R, "chain").agg(F.min("place").alias("least"))
    inside = materialized(placed.join(least, [R, "chain"]).where("place >= least").select(R, "sha"))
    released(*rounds, front, placed, crossings)
    present = commits.select(R, "sha")
    absent = commits.select(R, F.col("sha").alias("child"), F.explode("parents").alias("sha")).join(present, [R, "sha"], "left_anti")
    parents = absent.join(inside.withColumnRenamed("sha", "child"), [R, "child"], "left_semi").select(R, "sha")
    outside = materialized(parents.unionByName(starts.select(R, "sha").join(present, [R, "sha"], "left_anti")).distinct())
    return inside.unionByName(outside)


def ready_segments(segments: DataFrame, deps: DataFrame, progress: DataFrame, max_concurrency: int) -> DataFrame:
    """(repo_id, segment_id, slot): not complete, not running, all dependencies complete, as many as are free."""
    status = segments.join(progress.select(R, "segment_id", "status"), [R, "segment_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    done = status.where("status = 'complete'").select(R, F.col("segment_id").alias("dep_id"))
    unmet = deps.join(done, [R, "dep_id"], "left_anti").select(R, "segment_id").distinct()
    running = status.groupBy(R).agg(F.count(F.when(F.col("status") == "in-progress", 1)).alias("running"))
    able = status.where("status NOT IN ('complete', 'in-progress', 'failed')").join(unmet, [R, "segment_id"], "left_anti")
    able = able.withColumn("slot", F.row_number().over(Window.partitionBy(R).orderBy("creation_ord")))
    return able.join(running, R).where(F.col("slot") <= max_concurrency - F.col("running")).select(R, "segment_id", "slot")


def halted(segments: DataFrame, ready: DataFrame, progress: DataFrame) -> DataFrame:
    """(repo_id, reason) where nothing runs and nothing is ready: failed, or deadlock."""
    status = segments.join(progress.select(R, "segment_id", "status"), [R, "segment_id"], "left")
    left = status.groupBy(R).agg(F.count(F.when(F.coalesce("status", F.lit("pending")) != "complete", 1)).alias("left"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.count(F.when(F.col("status") == "in-progress", 1)).alias("running"))
    stuck = left.where("left > 0 AND running = 0").join(ready.select(R).distinct(), R, "left_anti")
    return stuck.select(R, F.when(F.col("failed") > 0, "failed").otherwise("deadlock").alias("reason"))


def fork_context(trunk: DataFrame, segments: DataFrame, window_size: int) -> DataFrame:
    """(repo_id, segment_id, ordinal < 0, sha): the last first-parent commits up to the fork, oldest first."""
    forks = segments.where("fork_from IS NOT NULL").join(trunk.select(R, F.col("sha").alias("fork_from"), F.col("depth_from_tip").alias("at")), [R, "fork_from"])
    wanted = forks.select(R, "segment_id", F.explode(F.sequence(F.lit(0), F.lit(window_size - 2))).alias("back"), "at") if window_size > 1 else forks.select(R, "segment_id", F.lit(0).alias("back"), "at").limit(0)
    return wanted.join(trunk, (wanted[R] == trunk[R]) & (trunk.depth_from_tip == wanted["at"] + wanted["back"])).select(wanted[R], "segment_id", (-F.col("back") - 1).cast("long").alias("ordinal"), "sha")


def merge_inputs(commits: DataFrame, segments: DataFrame, segment_commits: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo_id, segment_id, merge_sha, trunk_dep, branch_dep) of trunk segments that begin at a merge and have both."""
    kinds = deps.join(segments.select(R, F.col("segment_id").alias("dep_id"), F.col("type").alias("kind")), [R, "dep_id"])
    firsts = kinds.groupBy(R, "segment_id").agg(*[F.min_by(F.when(F.col("kind") == k, F.col("dep_id")), F.when(F.col("kind") == k, F.col("dep_ord"))).alias(f"{k}_dep") for k in ("trunk", "branch")])
    heads = segment_commits.where("ordinal = 0").join(commits.where(F.size("parents") > 1).select(R, "sha"), [R, "sha"]).join(segments.where("type = 'trunk'").select(R, "segment_id"), [R, "segment_id"])
    return heads.join(firsts, [R, "segment_id"]).where("trunk_dep IS NOT NULL AND branch_dep IS NOT NULL").select(R, "segment_id", F.col("sha").alias("merge_sha"), "trunk_dep", "branch_dep")


def segment_start_state(segments: DataFrame, deps: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo_id, segment_id, spec, changelog, parent_sha) from the tip of the first dependency; none: empty."""
    first = segments.select(R, "segment_id").join(deps.where("dep_ord = 0").select(R, "segment_id", "dep_id"), [R, "segment_id"], "left")
    at = tips.select(R, F.col("segment_id").alias("dep_id"), "spec", "changelog", "derived_sha")
    return first.join(at, [R, "dep_id"], "left").select(R, "segment_id", F.coalesce("spec", F.lit("")).alias("spec"), F.coalesce("changelog", F.lit("")).alias("changelog"), F.col("derived_sha").alias("parent_sha"))
