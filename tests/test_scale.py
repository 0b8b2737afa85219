"""Walks, orders, running values and frames on random and long inputs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import diffs, graph, ledger, longest, ranges, triggers, windows
from chronoloom.sources import readers
from chronoloom.streaming import ledger as streams


def dag(rng, n, width):
    """Commits of a random history with diamonds: (sha, parents), oldest first; some parents are absent."""
    out = []
    for k in range(n):
        parents = [f"c{rng.randrange(max(0, k - width), k)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3])) if k]
        out.append((f"c{k}", list(dict.fromkeys(parents + (["gone"] if rng.random() < 0.03 else [])))))
    return out


def commits_of(spark, graphs):
    rows = [(repo, sha, parents, f"m {sha}", len(g) - k - 1) for repo, g in graphs.items() for k, (sha, parents) in enumerate(g)]
    return spark.createDataFrame(rows, "repo_id long, sha string, parents array<string>, message string, log_pos long")


def test_ancestors_random(spark):
    rng = random.Random(1)
    graphs = {1: dag(rng, 120, 3), 2: dag(rng, 60, 60), 3: dag(rng, 200, 2), 4: [("c0", [])]}
    starts = [(1, "c119"), (1, "c40"), (2, "c30"), (2, "c55"), (3, "c150"), (4, "c0"), (4, "nowhere"), (5, "x")]
    want = set()
    for repo, sha in starts:
        parents, todo = dict(graphs.get(repo, [])), [sha]
        while todo:
            s = todo.pop()
            if (repo, s) not in want:
                want.add((repo, s))
                todo += parents.get(s, [])
    found = graph.ancestors(commits_of(spark, graphs), spark.createDataFrame(starts, "repo_id long, sha string")).collect()
    assert len(found) == len(want) and {(r.repo_id, r.sha) for r in found} == want


def test_ancestors_long(spark, monkeypatch):
    """2,000 generations with a branch in each tenth take as many rounds as steps between chains."""
    rows = spark.range(2_000).select(F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("t"), "id").alias("sha"), F.when(F.col("id") == 0, F.array().cast("array<string>")).when(F.col("id") % 10 == 0, F.array(F.concat(F.lit("t"), F.col("id") - 1), F.concat(F.lit("b"), "id"))).otherwise(F.array(F.concat(F.lit("t"), F.col("id") - 1))).alias("parents"), (4_000 - 2 * F.col("id")).alias("log_pos"))
    sides = spark.range(1, 200).select(F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("b"), F.col("id") * 10).alias("sha"), F.array(F.concat(F.lit("t"), F.col("id") * 10 - 5)).alias("parents"), (4_001 - 20 * F.col("id")).alias("log_pos"))
    rounds = []
    monkeypatch.setattr(graph, "TASK_POINTERS", 100)
    real = graph.materialized
    monkeypatch.setattr(graph, "materialized", lambda df: rounds.append(1) or real(df))
    found = graph.ancestors(rows.unionByName(sides), spark.createDataFrame([(1, "t1999")], "repo_id long, sha string"))
    assert found.count() == 2_000 + 199 and len(rounds) < 45


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_chase(spark, most):
    """Doubling over all tasks and walks inside tasks give the same rows."""
    rng = random.Random(most)
    after = {(repo, k): (k + rng.randrange(1, 4) if k < 35 else None) for repo in (1, 2) for k in range(40)} | {(3, 0): 1}
    pointers = spark.createDataFrame([(r, k, n) for (r, k), n in after.items() if n is not None], "repo_id long, node long, next long")
    starts = [(1, 0), (1, 7), (2, 3), (2, 3), (3, 0), (4, 9)]
    want = set()
    for repo, start in starts:
        at, hop = start, 0
        while at is not None:
            want.add((repo, start, at, hop))
            at, hop = after.get((repo, at)), hop + 1
    found = graph.chase(spark.createDataFrame(starts, "repo_id long, node long"), pointers, most).collect()
    assert len(found) == len(want) and {(r.repo_id, r.start, r.node, r.hop) for r in found} == want


def brute_longest(nodes, edges):
    dist = {}
    for node in sorted(nodes, key=lambda n: int(n[1:])):
        dist[node] = nodes[node][0] + max([nodes[node][1], *(dist[s] + g for s, d, g in edges if d == node and s in dist)])
    return dist


@pytest.mark.parametrize("block,reach", [(3, 2), (16, 6), (4, 100), (4096, 6)])
def test_longest_paths(spark, block, reach):
    rng = random.Random(block + reach)
    nodes = {f"n{k}": (rng.randrange(1, 9), rng.choice([0, 0, 5])) for k in range(90)}
    edges = [(f"n{rng.randrange(max(0, k - reach), k)}", f"n{k}", rng.randrange(4)) for k in range(1, 90) for _ in range(rng.randrange(3))]
    rows = spark.createDataFrame([(1, n, int(n[1:]), w, b) for n, (w, b) in nodes.items()], "repo_id long, node string, pos long, w long, base long")
    links = spark.createDataFrame([(1, *e) for e in edges] + [(1, "unknown", "n3", 50), (2, "n1", "n2", 50)], "repo_id long, src string, dst string, gain long")
    assert {r.node: r.dist for r in longest.longest_paths(rows, links, block).collect()} == brute_longest(nodes, edges)


def test_long_trunk(spark, monkeypatch):
    """A trunk of 100,000 merges, each of a branch heavier than the trunk beside it, takes a few tables."""
    n = 100_000
    trunk = spark.range(n).select(F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("trunk-"), "id").alias("segment_id"), F.lit("trunk").alias("type"), F.col("id").alias("creation_ord"), F.lit(2).cast("long").alias("n_commits"))
    sides = spark.range(n - 1).select(F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("branch-"), "id").alias("segment_id"), F.lit("branch").alias("type"), (F.col("id") + n).alias("creation_ord"), F.lit(3).cast("long").alias("n_commits"))
    name = lambda kind, k: F.concat(F.lit(f"{kind}-"), k).alias
    deps = spark.range(1, n).select(F.lit(1).cast("long").alias("repo_id"), name("trunk", F.col("id"))("segment_id"), F.explode(F.array(F.concat(F.lit("trunk-"), F.col("id") - 1), F.concat(F.lit("branch-"), F.col("id") - 1))).alias("dep_id"))
    deps = deps.unionByName(spark.range(n - 1).select(F.lit(1).cast("long").alias("repo_id"), name("branch", F.col("id"))("segment_id"), name("trunk", F.col("id"))("dep_id")))
    made = []
    real = longest.materialized
    monkeypatch.setattr(longest, "materialized", lambda df: made.append(1) or real(df))
    assert graph.critical_path(trunk.unionByName(sides), deps).first().critical_path == 2 * n + 3 * (n - 1) and len(made) <= 20


def test_dependency_cycle(spark):
    segments = spark.createDataFrame([(1, f"trunk-{k}", "trunk", k, 1) for k in range(3)] + [(1, "branch-0", "branch", 3, 4)], "repo_id long, segment_id string, type string, creation_ord long, n_commits long")
    ring = [(1, "trunk-1", "trunk-0", 0), (1, "trunk-2", "trunk-1", 0), (1, "trunk-0", "branch-0", 0), (1, "branch-0", "trunk-2", 0)]
    schema = "repo_id long, segment_id string, dep_id string, dep_ord int"
    with pytest.raises(ValueError, match="cycle"):
        graph.critical_path(segments, spark.createDataFrame(ring, schema))
    order = graph.segment_post_order(segments, spark.createDataFrame(ring, schema)).orderBy("post_pos").collect()
    assert [r.segment_id for r in order] == ["trunk-1", "trunk-2", "branch-0", "trunk-0"]


def test_post_order(spark):
    rng = random.Random(4)
    needs = {f"s{k}": [f"s{j}" for j in rng.sample(range(50), rng.randrange(4)) if j != k] for k in range(50)}
    needs = {k: [d for d in v if int(d[1:]) < int(k[1:])] if rng.random() < 0.7 else [d for d in v if int(d[1:]) < int(k[1:])][::-1] for k, v in needs.items()}
    created = rng.sample(list(needs), 50)
    order, seen = [], set()

    def visit(s):
        if s not in seen:
            seen.add(s)
            for d in needs[s]:
                visit(d)
            order.append(s)

    for s in created:
        visit(s)
    segments = spark.createDataFrame([(1, s, k) for k, s in enumerate(created)], "repo_id long, segment_id string, creation_ord long")
    deps = spark.createDataFrame([(1, s, d, k) for s, v in needs.items() for k, d in enumerate(v)] + [(1, "s0", "unknown", 0)], "repo_id long, segment_id string, dep_id string, dep_ord int")
    assert [r.segment_id for r in graph.segment_post_order(segments, deps).orderBy("post_pos").collect()] == order


@pytest.mark.parametrize("size", [4, 50])
def test_running(spark, size):
    rng = random.Random(size)
    rows = [(repo, order, rng.choice([None, rng.randrange(9)]), rng.choice([None, None, f"v{order}"])) for repo in (1, None, 3) for order in sorted(rng.sample(range(-40, 300), 120))]
    df = spark.createDataFrame(rows, "repo_id long, o long, x long, v string").repartition(5)
    found = ranges.running(df, ["repo_id"], "o", {"total": F.col("x"), "n": F.lit(1)}, {"last": F.col("v")}, size).collect()
    want, state = {}, {}
    for repo, o, x, v in rows:
        total, n, last = state.get(repo, (0, 0, None))
        want[repo, o] = (total + (x or 0), n + 1, last)
        state[repo] = (total + (x or 0), n + 1, v or last)
    assert {(r.repo_id, r.o): (r.total, r.n, r["last"]) for r in found} == want and found[0].asDict().keys() == {"repo_id", "o", "x", "v", "total", "n", "last"}


@pytest.mark.parametrize("size", [2, 7])
def test_windows_over_ranges(spark, size):
    rows = [(1, s, o, f"{s}{o}") for s in "ab" for o in [*range(0, 20), *range(23, 60)]]
    seed = [(1, "a", -k, f"seed{k}") for k in range(1, 5)]
    schema = "repo_id long, segment_id string, ordinal long, sha string"
    found = windows.commit_windows(spark.createDataFrame(rows, schema), 5, spark.createDataFrame(seed, schema), size).collect()
    want = {}
    for s in "ab":
        own = [x[3] for x in (sorted(seed, key=lambda x: x[2]) if s == "a" else [])] + [x[3] for x in rows if x[1] == s]
        want |= {sha: own[max(0, k - 4) : k + 1] for k, sha in enumerate(own) if not sha.startswith("seed")}
    assert {r.sha: r.window for r in found} == want and set(found[0].asDict()) == {"repo_id", "segment_id", "ordinal", "sha", "window"}


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_count_triggers(spark, size):
    rng = random.Random(9)
    steps = [(repo, k, rng.choice(["trunk", "trunk", "branch"]), f"s{repo}-{k}") for repo in (1, 2) for k in range(1, 80)]
    df = spark.createDataFrame(steps, "repo_id long, step_no long, segment_type string, original_sha string").repartition(3)
    mixed = {(r.repo_id, r.step_no): r.fires for r in triggers.trigger_every_n_trunk(df, 4, compat=True, size=size).collect()}
    plain = {(r.repo_id, r.step_no): r.fires for r in triggers.trigger_every_n_trunk(df, 4, size=size).collect()}
    fired = triggers.trigger_every_n(df, 5, size)
    epochs = {(r.repo_id, r.step_no): (r.epoch, r.since_sha) for r in triggers.reconciliation_epochs(fired, size).collect()}
    assert not any(r.fires for r in triggers.trigger_none(df).collect())
    for repo in (1, 2):
        own = [s for s in steps if s[0] == repo]
        trunk = last = 0
        for k, (_, no, kind, _) in enumerate(own):
            trunk += kind == "trunk"
            hit = kind == "trunk" and trunk - last >= 4
            last = k + 1 if hit else last
            assert mixed[repo, no] == hit and plain[repo, no] == (kind == "trunk" and trunk % 4 == 0)
            assert epochs[repo, no] == (k // 5, own[k // 5 * 5 - 1][3] if k >= 5 else None)


def test_split_log(spark, tmp_path):
    """A log that is read in many splits is numbered as one."""
    for name, n in (("one", 900), ("two", 40)):
        (tmp_path / f"{name}.log").write_text("".join(f"s{k}<<SEP>>p{k}<<SEP>>größe {k} {'x' * (k % 70)}<<SEP>>2024-01-01T00:00:00+00:00<<REC>>\n" + ("\n<<REC>>" if k % 9 == 0 else "") for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.read_commit_log(spark, f"{tmp_path}/*.log")
        assert spark.read.option("lineSep", readers.REC).text(f"{tmp_path}/*.log").rdd.getNumPartitions() > 10
        found = sorted((r.repo, r.log_pos, r.sha) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == [(name, k, f"s{k}") for name, n in (("one", 900), ("two", 40)) for k in range(n)]


def test_write_state(spark, tmp_path):
    repos = ["a", "b+c d", "007"]
    scalars = spark.createDataFrame([(r, 1, "/p", "main", "c0", {"windowSize": "5"}, "h", 0.75, 3, 2, "c1", 40) for r in repos], "repo string, version int, repoPath string, targetRef string, rootCommit string, config map<string,string>, branchHead string, totalCostUsd double, totalSteps long, lastReconciliationStep long, lastReconciliationSha string, cumulativeDiffTokensSinceLastReconciliation long")
    segments = spark.createDataFrame([(r, f"trunk-{k}", "trunk", k, None, None) for r in repos[:2] for k in range(12)], "repo string, segment_id string, type string, creation_ord long, fork_from string, merges_into string")
    members = spark.createDataFrame([(r, f"trunk-{k}", o, f"c{k}-{o}") for r in repos[:2] for k in range(12) for o in range(11)], "repo string, segment_id string, ordinal long, sha string")
    deps = spark.createDataFrame([(r, f"trunk-{k}", 0, f"trunk-{k - 1}") for r in repos[:2] for k in range(1, 12)], "repo string, segment_id string, dep_ord int, dep_id string")
    progress = spark.createDataFrame([(r, f"trunk-{k}", "pending" if k else "in-progress", f"spec {r}", "") for r in repos[:2] for k in range(12)], "repo string, segment_id string, status string, spec string, changelog string")
    ledger = spark.createDataFrame([("a", "trunk-0", k, f"c0-{k}", f"d{k}", "opus", 0.25) for k in range(11)], "repo string, segment_id string, seq long, original_sha string, derived_sha string, model string, cost double").withColumn("ts", F.to_timestamp(F.lit("2024-01-02T03:04:05.678Z")))
    mapping = ledger.select("repo", "original_sha", "derived_sha")
    merges = spark.createDataFrame([("a", f"m{k}", f"d{k}", "trunk-0", "branch-0", k) for k in range(3)], "repo string, merge_sha string, derived_sha string, trunk_dep string, branch_dep string, ord int").withColumn("ts", F.lit(None).cast("timestamp"))
    checks = spark.createDataFrame([("b+c d", 2, "c1", "opus", 0.5, 1, False, 0)], "repo string, at_step long, at_sha string, model string, cost double, n_findings long, skipped boolean, ord int").withColumn("ts", F.to_timestamp(F.lit("2024-01-02T03:04:05.678Z")))
    made = readers.state_documents(scalars, segments, members, deps, progress, ledger, mapping, merges, checks, "stepSha", "headSha")
    readers.write_state(made, str(tmp_path / "state"))
    back = readers.read_state(spark, str(tmp_path / "state"), "stepSha", "headSha")
    one = {r.repo: r.asDict(True) for r in made.withColumnRenamed("headSha", "branchHead").collect()}
    assert {r.repo: r.asDict(True) for r in back.collect()} == one and set(one) == set(repos)
    assert [s["id"] for s in one["a"]["segments"]] == [f"trunk-{k}" for k in range(12)] and one["a"]["segments"][3]["commits"][10] == "c3-10"
    same = lambda x, y: sorted(map(str, x.select(y.columns).collect())) == sorted(map(str, y.collect()))
    assert same(readers.steps_of_state(back, "stepSha"), ledger) and same(readers.sha_map_of_state(back), mapping)
    assert same(readers.merges_of_state(back, "stepSha"), merges) and same(readers.reconciliations_of_state(back), checks)


@pytest.mark.parametrize("size,threshold", [(3, 10), (16, 40), (7, 2000)])
def test_token_pointers(spark, size, threshold):
    rng = random.Random(size)
    steps = [(repo, no, rng.choice([0, 1, 3, 9, None, 60])) for repo in (1, 2) for no in sorted(rng.sample(range(1, 400), 150))] + [(3, 1, 1)]
    df = spark.createDataFrame(steps, "repo_id long, step_no long, diff_tokens long").repartition(3)
    found = {(r.repo_id, r.step_no): r.fires for r in triggers.token_fires_by_pointers(df, threshold, size).collect()}
    mixed = {(r.repo_id, r.step_no): r.fires for r in triggers.trigger_token_count(df, threshold, 100).collect()} if size == 3 else found
    want = {}
    for repo in (1, 2, 3):
        own = [x for x in steps if x[0] == repo]
        want |= dict(zip([x[:2] for x in own], triggers.token_fires([x[2] or 0 for x in own], threshold)[0]))
    assert found == want and mixed == want


def test_split_oversized_random(spark):
    rng = random.Random(2)
    paths = sorted({"/".join(rng.choice(["packages", "src", "a", "b", "lib"]) for _ in range(rng.randrange(1, 6))) for _ in range(220)})
    rows = [(c, p, rng.randrange(60)) for c in (1, 2) for p in paths if rng.random() < 0.7]

    def split(key, files):
        if sum(t for _, t in files) <= 90:
            return {p: key for p, _ in files}
        subs = {}
        for p, t in files:
            sub = p.split("/")[0] if key == "." else key + "/" + p[len(key) + 1 :].split("/")[0] if p.startswith(key + "/") else p
            subs.setdefault(sub, []).append((p, t))
        return {p: key for p, _ in files} if len(subs) <= 1 else {p: k for s, f in subs.items() for p, k in split(s, f).items()}

    want = {}
    for change in (1, 2):
        groups = {}
        for c, p, tokens in rows:
            if c == change:
                parts = p.split("/")
                key = "." if len(parts) == 1 else "/".join(parts[:2]) if parts[0] == "packages" and len(parts) >= 3 else parts[0]
                groups.setdefault(key, []).append((p, tokens))
        want |= {(change, p): k for g, f in groups.items() for p, k in split(g, f).items()}
    found = diffs.split_oversized(spark.createDataFrame(rows, "change_id long, path string, tokens long"), ["change_id"], 90).collect()
    assert {(r.change_id, r.path): r.chunk_key for r in found} == want and len(found) == len(rows)
    assert set(found[0].asDict()) == {"change_id", "path", "tokens", "chunk_key"}


def test_split_large_file_random(spark):
    rng = random.Random(3)
    texts = ["\n".join("x" * rng.choice([0, 1, 5, 30, 200]) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n"]) for _ in range(40)] + ["", None, "y" * 999]
    found = diffs.split_large_file(spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumn("path", F.lit("p")), ["id"], 20).collect()
    want = {}
    for k, text in enumerate(texts):
        if text is None:
            continue
        if -(-len(text) // 4) <= 20:
            want[k, 0] = ("p", text)
            continue
        lines, start, part = text.split("\n"), 0, 0
        while start < len(lines):
            end, size = start + 1, len(lines[start]) + 1
            while end < len(lines) and -(-(size + len(lines[end]) + 1) // 4) <= 20:
                size += len(lines[end]) + 1
                end += 1
            want[k, part] = (f"p:{start + 1}-{end}", "\n".join(lines[start:end]) + "\n")
            start, part = end, part + 1
    assert {(r.id, r.part_ord): (r.path, r.content) for r in found} == want


def test_stream_segments(spark, tmp_path):
    """Steps, explicit status and resets, over two runs of a stream, against the batch operators on what is left."""
    rng = random.Random(7)
    events = []
    for segment in range(6):
        for no in range(30):
            kind = rng.choice(["step"] * 8 + ["status", "reset"])
            events.append((1 + segment % 2, f"s{segment}", no, kind, rng.choice(["complete", "failed"]) if kind == "status" else None, f"o{segment}-{no % 9}", f"d{segment}-{no}", 0.25 * (no % 3), f"spec {no}", f"log {no}"))
    schema = "repo_id long, segment_id string, no long, kind string, status string, original_sha string, derived_sha string, cost double, spec string, changelog string"
    for part in (0, 1):  # the second run repeats some events
        spark.createDataFrame([e for e in events if e[2] < 18] if part == 0 else [e for e in events if e[2] >= 15], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.stream_segments(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    totals, mapping, progress = streams.segment_views(spark, f"{tmp_path}/out")
    left, told = [], []
    for segment in {e[1] for e in events}:
        own = [e for e in events if e[1] == segment]
        after = max([e[2] for e in own if e[3] == "reset"], default=-1)
        left += [e for e in own if e[2] > after and e[3] == "step"]
        told += [e for e in own if e[2] > after and e[3] == "status"]
    rows = spark.createDataFrame(left, schema).withColumn("seq", F.col("no"))
    segments = spark.createDataFrame([(1 + k % 2, f"s{k}") for k in range(6)], "repo_id long, segment_id string")
    status = spark.createDataFrame([(e[0], e[1], e[2], e[4]) for e in told], "repo_id long, segment_id string, seq long, status string")
    same = lambda x, y: sorted(map(str, x.select(y.columns).collect())) == sorted(map(str, y.collect()))
    assert same(progress, ledger.segment_progress(segments, rows, status)) and same(mapping, ledger.sha_map(rows.select("repo_id", "original_sha", "derived_sha", "seq")))
    none = spark.createDataFrame([], "repo_id long, cost double")
    assert {(r.repo_id, r.total_steps, float(r.total_cost)) for r in totals.where("total_steps > 0").collect()} == {(r.repo_id, r.total_steps, float(r.total_cost)) for r in ledger.ledger_totals(rows, none).collect()}


def test_sha_map_by_time(spark):
    """A commit in two segments takes the sha that was written last, not the one deeper in its segment."""
    rows = [(1, "trunk-0", 7, "a", "early", "2024-01-01"), (1, "branch-0", 0, "a", "late", "2024-01-02"), (2, "trunk-0", 0, "a", "other", "2024-01-01")]
    df = spark.createDataFrame(rows, "repo_id long, segment_id string, seq long, original_sha string, derived_sha string, ts string")
    assert {(r.repo_id, r.derived_sha) for r in ledger.sha_map(df).collect()} == {(1, "late"), (2, "other")}


def test_budget_counts_parts(spark):
    """A split file enters by its own tokens and adds those of its parts."""
    rng = random.Random(5)
    files = [(1, k, f"d/f{k}.md", "\n".join("x" * rng.choice([3, 17, 40]) for _ in range(rng.randrange(1, 30)))) for k in range(40)]
    df = spark.createDataFrame(files, "repo_id long, file_ord int, path string, content string")
    parts = diffs.split_large_file(df, ["repo_id", "file_ord"], 12)
    adds = {r.file_ord: r.t for r in parts.groupBy("file_ord").agg(F.sum("tokens").alias("t")).collect()}
    total, skipped = 0, []
    for _, k, path, text in files:
        tokens = -(-len(text) // 4)
        if total + tokens > 900:
            skipped.append(path)
        else:
            total += adds[k]
    chunked, left = diffs.read_tree_chunks(df, ["repo_id"], [], 900, 12, 10**6)
    assert sorted(r.path for r in left.collect()) == sorted(skipped) and skipped
    assert chunked.agg(F.sum("tokens")).first()[0] == total
