"""Longest paths in dependency graphs by contraction, so that a chain of n links takes a few rounds, not n.

The order of nodes is cut into blocks. A task closes one block: it finds, along paths inside it, what each edge that comes
in adds to each node that an edge leaves from. These nodes and composed edges are a smaller graph of the same kind, which is
solved the same way; its answers then enter the blocks, which close once more. Any order gives the same answer; one in which
dependencies are near each other leaves few edges between blocks. Where a graph doesn't shrink, it is relaxed link by link.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialized, released

R = "repo_id"
BLOCK = 4096


def _topological(names: list[str], edges: list[tuple[str, str, int]]) -> tuple[list[str], dict[str, list[tuple[str, int]]]]:
    """Nodes in an order that puts sources first, and what leaves each; raises ValueError on a cycle."""
    leaving, waits = defaultdict(list), dict.fromkeys(names, 0)
    for source, target, gain in edges:
        leaving[source].append((target, gain))
        waits[target] += 1
    ready = [n for n in names if not waits[n]]
    for node in ready:
        for target, _ in leaving[node]:
            waits[target] -= 1
            if not waits[target]:
                ready.append(target)
    if len(ready) < len(names):
        raise ValueError("the dependencies have a cycle")
    return ready, leaving


def _spread(order: list[str], leaving: dict, weight: dict[str, int], dist: dict[str, int]) -> dict[str, int]:
    """The largest distances along the edges from what ``dist`` holds; a node's distance includes its own weight."""
    for node in order:
        if node in dist:
            for target, gain in leaving[node]:
                dist[target] = max(dist.get(target, -1), dist[node] + gain + weight[target])
    return dist


def _block(nodes: list[tuple], links: list[tuple]) -> tuple:
    """Order, edges, weights and distances inside a block; nodes are (node, w, base, out), links (src, dst, gain, inner)."""
    order, leaving = _topological([n for n, *_ in nodes], [(s, t, g) for s, t, g, inner in links if inner])
    weight = {n: w for n, w, _, _ in nodes}
    return order, leaving, weight, _spread(order, leaving, weight, {n: w + base for n, w, base, _ in nodes})


def _by_block(nodes: DataFrame, edges: DataFrame, made, columns: str) -> DataFrame:
    """``made`` (of repo, block, nodes, links) for every block; sorted rows stream through the tasks, which hold one block at a time."""
    none = lambda kind: F.lit(None).cast(kind)
    left = nodes.select(R, "b", F.lit(0).alias("kind"), F.col("node").alias("one"), none("string").alias("two"), F.col("w").alias("x"), F.col("base").alias("y"), F.col("out").alias("flag"))
    right = edges.select(R, "b", F.lit(1).alias("kind"), F.col("src").alias("one"), F.col("dst").alias("two"), F.col("gain").alias("x"), none("long").alias("y"), F.col("inner").alias("flag"))
    schema = T.StructType([nodes.schema[R], *T.StructType.fromDDL(columns).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, types = None, ([], []), None

        def close() -> pa.RecordBatch:
            columns = list(zip(*made(*now, *held))) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64() if f.dataType == T.LongType() else pa.string() for f in schema.fields[1:]]]
            for repo, b, kind, one, two, x, y, flag in zip(*[c.to_pylist() for c in batch.columns]):
                if now != (repo, b):
                    if now is not None:
                        yield close()
                    now, held = (repo, b), ([], [])
                held[kind].append((one, x, y, flag) if kind == 0 else (one, two, x, flag))
        if now is not None:
            yield close()

    return materialized(left.unionByName(right).repartition(R, "b").sortWithinPartitions(R, "b", "kind").mapInArrow(run, schema))


def _closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node, dist) of every block by itself."""
    return _by_block(nodes, edges.where("inner"), lambda repo, b, some, links: [(repo, n, d) for n, d in _block(some, links)[3].items()], "node string, dist long")


def _contracted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with dst null: (src, b, gain), the longest path inside its block to a node that an edge leaves to another; others: (src, dst, gain)."""

    def contract(repo, b: int, some: list[tuple], links: list[tuple]) -> list[tuple]:
        order, leaving, weight, dist = _block(some, links)
        ports = [n for n, _, _, out in some if out]
        rows = [(repo, b, p, None, dist[p]) for p in ports]
        best: dict[tuple[str, str], int] = {}
        coming = defaultdict(list)
        for source, target, gain, inner in links:
            if not inner:
                coming[target].append((source, gain))
        for target, sources in coming.items():
            found = _spread(order, leaving, weight, {target: weight[target]})
            for p in ports:
                if p in found:
                    for source, gain in sources:
                        best[source, p] = max(best.get((source, p), -1), gain + found[p])
        return rows + [(repo, b, s, t, g) for (s, t), g in best.items()]

    return _by_block(nodes, edges, contract, "b long, src string, dst string, gain long")


def _relaxed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The plain way: a round a link. Raises ValueError on a cycle: no chain has more links than there are nodes."""
    dist, rounds, longest = materialized(nodes.select(R, "node", (F.col("w") + F.col("base")).alias("dist"))), 0, None
    while True:
        rounds += 1
        if rounds >= 64:
            longest = nodes.count() if longest is None else longest
            if rounds > longest + 1:
                raise ValueError("the dependencies have a cycle")
        ahead = edges.join(dist.withColumnRenamed("node", "src"), [R, "src"]).groupBy(R, F.col("dst").alias("node")).agg(F.max(F.col("dist") + F.col("gain")).alias("before"))
        now = materialized(nodes.join(ahead, [R, "node"], "left").select(R, "node", (F.col("w") + F.greatest("base", F.coalesce("before", F.lit(0)))).alias("dist")))
        if now.join(dist.withColumnRenamed("dist", "old"), [R, "node"]).where("dist <> old").isEmpty():
            released(dist)
            return now
        released(dist)
        dist = now


def longest_paths(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(repo_id, node, dist): w(node) + the largest of base(node) and dist(src) + gain over the edges (repo_id, src, dst, gain).

    ``nodes`` are (repo_id, node, pos, w, base), base not negative; ``block`` positions make a block, so pos should number a
    repository's nodes without large gaps. Edges from or to unknown nodes count for nothing. Raises ValueError on a cycle.
    """
    placed = nodes.withColumn("b", F.expr(f"pos div {block}"))
    at = lambda end: placed.select(R, F.col("node").alias(end), F.col("b").alias(f"b_{end}"))
    links = edges.join(at("src"), [R, "src"]).join(at("dst"), [R, "dst"]).groupBy(R, "src", "dst").agg(F.max("gain").alias("gain"), F.first("b_src").alias("b_src"), F.first("b_dst").alias("b"))
    links = materialized(links.withColumn("inner", F.col("b_src") == F.col("b")))
    cross = links.where("NOT inner")
    if cross.isEmpty():
        return _closed(placed.withColumn("out", F.lit(False)), links)
    ports = cross.select(R, F.col("src").alias("node"), F.lit(True).alias("leaves")).distinct()
    placed = materialized(placed.join(ports, [R, "node"], "left").withColumn("out", F.coalesce("leaves", F.lit(False))).drop("leaves"))
    size = placed.agg(F.count("*").alias("n"), F.count_if("out").alias("ports"), F.count_distinct(R, "b").alias("blocks")).first()
    if 2 * size.ports > size.n:
        return _relaxed(placed, links)
    small = _contracted(placed, links)
    together = max(2, block * size.blocks // size.ports)  # so many blocks have about a block of ports
    inner_nodes = small.where("dst IS NULL").select(R, F.col("src").alias("node"), F.expr(f"b * {block} div {together}").alias("pos"), F.lit(0).cast("long").alias("w"), F.col("gain").alias("base"))
    far = longest_paths(inner_nodes, small.where("dst IS NOT NULL").select(R, "src", "dst", "gain"), block)
    entering = cross.join(far.withColumnRenamed("node", "src"), [R, "src"]).groupBy(R, F.col("dst").alias("node")).agg(F.max(F.col("dist") + F.col("gain")).alias("enters"))
    known = placed.join(entering, [R, "node"], "left").withColumn("base", F.greatest("base", F.coalesce("enters", F.lit(0))))
    out = _closed(known, links)
    released(links, placed, small, far)
    return out
