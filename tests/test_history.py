"""Golden values of a small history of known shape, literal texts, and streams against batch."""

import json

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as t
from chronoloom.operators import changelog, diffs, graph, ledger, planning, triggers, windows
from chronoloom.sources import readers
from chronoloom.streaming import ledger as streams

# label: parents, oldest first
HISTORY = {"A": "", "B": "A", "C": "B", "X1": "C", "X2": "X1", "Y1": "C", "Y2": "Y1", "Y3": "Y2", "M1": "C X2", "D": "M1", "E": "D", "M2": "E Y3"} | {b: a for a, b in zip(["M2", *"FGHIJKLMNOPQRST"], "FGHIJKLMNOPQRSTU")}


@pytest.fixture(scope="module")
def history(spark):
    rows = [(1, sha, parents.split(), f"commit {sha}", len(HISTORY) - k - 1) for k, (sha, parents) in enumerate(HISTORY.items())]
    commits = spark.createDataFrame(rows, "repo_id long, sha string, parents array<string>, message string, log_pos long")
    return commits, graph.decompose(commits, spark.createDataFrame([(1, "U")], "repo_id long, sha string"))


def test_segments(history):
    commits, parts = history
    members = {}
    for r in parts["segment_commits"].orderBy("ordinal").collect():
        members.setdefault(r.segment_id, []).append(r.sha)
    assert members["trunk-0"] == ["A", "B", "C"] and members["trunk-1"] == ["M1", "D", "E"] and members["trunk-2"] == ["M2", *"FGHIJKLMNOPQRSTU"]
    assert sorted([members["branch-0"], members["branch-1"]]) == [["X1", "X2"], ["Y1", "Y2", "Y3"]] and len(members) == 5
    forks = {(r.fork_from, r.merges_into) for r in parts["segments"].where("type = 'branch'").collect()}
    assert forks == {("C", "M1"), ("C", "M2")}


def test_plan(history, spark):
    commits, parts = history
    deps = graph.segment_deps(commits, parts["segments"], parts["segment_commits"])
    models = planning.model_distribution(parts["segment_commits"], parts["segments"], commits)
    assert {r.model: r.steps for r in models.collect()} == {"opus": 3, "sonnet": 25}
    none = spark.createDataFrame([], "repo_id long, done long, cost decimal(28,6)")
    points = planning.merge_points(parts["segment_commits"], parts["segments"], commits)
    row = planning.setup_stats(parts["segments"], models, graph.critical_path(parts["segments"], deps), none, points).first()
    assert (row.merge_points, row.is_resume, row.cost_so_far) == (2, False, 0)
    assert [tuple(x) for x in row.by_type] == [("branch", 2, 5), ("trunk", 3, 23)] and [tuple(x) for x in row.by_model] == [("opus", 3), ("sonnet", 25)]
    assert (row.total_steps, row.critical_path, float(row.low), float(row.high), row.wall_low, row.wall_high, row.wall_text) == (28, 25, 0.4, 2.0, 1125, 2250, "18m - 37m")
    order = [r.segment_id for r in graph.segment_topo_order(parts["segments"], deps).orderBy("topo_pos").collect()]
    assert all(order.index(r.dep_id) < order.index(r.segment_id) for r in deps.collect())
    merges = {r.merge_sha: (r.trunk_dep, r.branch_dep) for r in graph.merge_inputs(commits, parts["segments"], parts["segment_commits"], deps).collect()}
    assert set(merges) == {"M1", "M2"} and merges["M1"][0] == "trunk-0"
    progress = parts["segments"].select("repo_id", "segment_id", F.when(F.col("segment_id") == "trunk-0", "complete").otherwise("pending").alias("status"))
    ready = graph.ready_segments(parts["segments"], deps, progress, 4)
    assert {r.segment_id for r in ready.collect()} == {"branch-0", "branch-1"} and graph.halted(parts["segments"], ready, progress).count() == 0
    assert graph.missing_refs(commits, spark.createDataFrame([(1, "none")], "repo_id long, sha string")).count() == 1


def test_ancestors(history, spark):
    commits, _ = history
    found = graph.ancestors(commits, spark.createDataFrame([(1, "M1"), (1, "absent")], "repo_id long, sha string"))
    assert {r.sha for r in found.collect()} == {"A", "B", "C", "X1", "X2", "M1", "absent"}


def test_windows(history):
    commits, parts = history
    seed = graph.fork_context(parts["trunk"], parts["segments"], 4)
    rows = windows.commit_windows(parts["segment_commits"], 4, seed).where("segment_id LIKE 'branch%'")
    found = {r.sha: r.window for r in rows.collect()}
    assert found["X1"] == ["A", "B", "C", "X1"] and found["Y3"] == ["C", "Y1", "Y2", "Y3"]
    split = windows.context_split(windows.commit_windows(parts["segment_commits"], 3), 5).where("sha = 'E'").first()
    assert split["full"] == ["M1", "D", "E"] and split["context"] == [] and split["label"] == "M1..E"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column("c").alias("r")).first().r


def test_functions(spark):
    assert [one(spark, t.estimate_tokens, x) for x in ("", "abc", "abcde", None)] == [0, 1, 2, None]
    assert one(spark, t.utf16_length, "a😀b") == 4
    assert [one(spark, t.group_key, x) for x in ("a.ts", "packages/x/y.ts", "packages/y.ts", "src/a/b.ts")] == [".", "packages/x", "packages", "src"]
    assert one(spark, t.is_binary_path, "a/B.PNG") and not one(spark, t.is_binary_path, "png")
    assert [one(spark, t.format_duration, x, "long") for x in (59, 60, 3600, 5400)] == ["59s", "1m", "1h", "1h 30m"]
    assert one(spark, t.original_sha, "x\nOriginal: " + "a" * 40 + ' "m"') == "a" * 40 and one(spark, t.original_sha, "none") is None
    assert [one(spark, t.module_path_error, x) for x in ("/a.md", "a/../b.md", "a.txt", "a.md")] == ["absolute", "parent", "extension", None]
    assert one(spark, t.tokens_udf(len), "abc") == 3
    assert not one(spark, lambda c: t.not_ignored(c, ["*.test.ts", "a+b"]), "x/y.test.ts") and one(spark, lambda c: t.not_ignored(c, ["*.test.ts"]), "x/test.ts")
    assert one(spark, lambda c: t.fill_template("{a} {b}", {"a": F.col(c), "b": F.lit("2")}), "1") == "1 2"


def test_diffs(spark):
    text = "diff --git a/packages/x/a.ts b/packages/x/a.ts\n@@ -1 +1 @@\n-a\n+b\n+c\ndiff --git a/pnpm-lock.yaml b/pnpm-lock.yaml\n+z\ndiff --git \"a/o d\" \"b/o d\"\n+q\n"
    files = diffs.parse_diff(spark.createDataFrame([(1, text)], "id int, diff string"), ["id"])
    assert [r.path for r in files.orderBy("file_ord").collect()] == ["packages/x/a.ts", "pnpm-lock.yaml"]
    stat = {r.path: (r.added, r.removed) for r in diffs.diffstat(files, ["id"]).collect()}
    assert stat == {"packages/x/a.ts": (2, 1), "pnpm-lock.yaml": (0, 0)}
    tree = spark.createDataFrame([(1, k, p, n) for k, (p, n) in enumerate([("src/a/b/x.ts", 60), ("src/a/b/y.ts", 60), ("src/c.ts", 10), ("top.md", 5)])], "id int, file_ord int, path string, tokens long")
    found = {r.path: r.chunk_key for r in diffs.split_oversized(tree, ["id"], 100).collect()}
    assert found == {"src/a/b/x.ts": "src/a", "src/a/b/y.ts": "src/a", "src/c.ts": "src/c.ts", "top.md": "."}
    admitted = {r.path: r.admitted for r in diffs.admit_within_budget(tree, ["id"], 75).collect()}
    assert admitted == {"src/a/b/x.ts": True, "src/a/b/y.ts": False, "src/c.ts": True, "top.md": True}
    source = spark.createDataFrame([(1, "f", "aaaa\nbbbb\ncccccccccccccccc\nd"), (2, "g", "x")], "id int, path string, content string")
    parts = diffs.split_large_file(source, ["id"], 3).orderBy("id", "part_ord").collect()
    assert [(r.path, r.content, r.tokens) for r in parts] == [("f:1-2", "aaaa\nbbbb\n", 3), ("f:3-3", "cccccccccccccccc\n", 5), ("f:4-4", "d\n", 1), ("g", "x", 1)]


def test_reconciliation_source(spark):
    """An accepted diff without chunks is no reason to read the tree; a rejected or absent one is."""
    stats = spark.createDataFrame([(1, "x" * 40), (2, "x" * 4000), (3, "x")], "id int, stat string")
    files = spark.createDataFrame([(1, 0, "src/a.ts", 5), (2, 0, "src/b.ts", 5), (3, 0, "logo.png", 5)], "id int, file_ord int, path string, tokens long")
    tree = spark.createDataFrame([(k, "src/t.ts", "src", 9) for k in (1, 2, 3, 4)], "id int, path string, chunk_key string, tokens long")
    accepted = diffs.accepted_diffs(stats, ["id"], 200)
    found = diffs.reconciliation_source(diffs.read_diff_chunks(files, stats, ["id"], [], 200, 100), accepted, tree, ["id"])
    assert sorted((r.id, r.mode, r.path) for r in found.collect()) == [(1, "diff", "src/a.ts"), (2, "tree", "src/t.ts"), (4, "tree", "src/t.ts")]
    assert {r.id for r in diffs.accepted_diffs(stats, ["id"], 0).collect()} == {1, 2, 3}
    chunk = spark.createDataFrame([(1, "src/a", 1, "b.ts", "two"), (1, "src/a", 0, "a.ts", "one")], "id int, chunk_key string, file_ord int, path string, content string")
    row = diffs.render_source_chunk(chunk, ["id"]).first()
    assert (row.file_name, row.text) == ("source/src--a.txt", "--- a.ts ---\none\n\n--- b.ts ---\ntwo")


def test_tree_chunks(spark):
    rows = [(1, 0, "src/a.ts", "x" * 40), (1, 1, "src/b.ts", "y" * 400), (1, 2, "src/c.ts", "z" * 20), (1, 3, "logo.png", "q"), (1, 4, "d.lock", "w"), (1, 5, "e.bin2", None)]
    files = spark.createDataFrame(rows, "id int, file_ord int, path string, content string")
    chunked, skipped = diffs.read_tree_chunks(files, ["id"], ["d.lock"], 20, 50, 1000)
    assert sorted(r.path for r in chunked.collect()) == ["src/a.ts", "src/c.ts"] and sorted(r.path for r in skipped.collect()) == ["e.bin2", "src/b.ts"]


def test_folds(spark):
    """Repeated step numbers add no rows, state runs on across batches, and each key begins anew."""
    rows = [(k % 3, k // 3, 1 if k % 2 else 3) for k in range(3000)] + [(0, 5, 1), (None, 1, None)]
    table = spark.createDataFrame(rows, "repo_id long, step_no long, diff_tokens long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = triggers.trigger_token_count(table, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for repo in (0, 1, 2):
        own = sorted((s, n) for r, s, n in rows if r == repo)
        want = triggers.token_fires([n for _, n in own], 10)[0]
        assert [r.fires for r in sorted((r for r in found if r.repo_id == repo), key=lambda r: (r.step_no, r.diff_tokens))] == want


def test_cycles(spark):
    ring = spark.createDataFrame([(1, k, (k + 1) % 3) for k in range(3)], "repo_id long, node long, next long")
    with pytest.raises(ValueError, match="cycle"):
        graph.chase(ring.where("node = 0").select("repo_id", "node"), ring)
    with pytest.raises(ValueError, match="cycle"):
        graph.chase(ring.where("node = 0").select("repo_id", "node"), ring, 0)


def test_step_plan_seed(history):
    commits, parts = history
    merges = commits.where("sha = 'M1'").selectExpr("repo_id", "'trunk-1' AS segment_id")
    seed = graph.fork_context(parts["trunk"], parts["segments"], 4)
    plan = {r.sha: r for r in windows.step_plan(parts["segment_commits"], commits, merges, 4, 1, seed=seed).collect()}
    assert plan["X1"].context == ["A", "B", "C"] and plan["X1"].full == ["X1"] and plan["A"].step_type == "initial-commit"
    assert plan["M1"].step_type == "merge" and plan["D"].window == ["D"] and plan["M1"].window == ["M1"]


def test_changelogs(spark):
    side = lambda text: spark.createDataFrame([(1, text)], "id int, text string")
    trunk, branch = side("# log\n## aaaaaaa1 x\none"), side("intro\n## aaaaaaa1 x\none\n## bbbbbbb two\n## no sha")
    assert [r.entry for r in changelog.unique_entries(trunk, branch, ["id"]).collect()] == ["\n## bbbbbbb two"]
    merged = changelog.merge_changelogs(trunk, branch, spark.createDataFrame([(1, "c" * 40, "m")], "id int, merge_sha string, merge_text string"), ["id"]).first().text
    assert merged == "# log\n## aaaaaaa1 x\none\n## bbbbbbb two\n## cccccccc (merge)\n\nm\n"


def test_sources(spark, tmp_path):
    (tmp_path / "one.log").write_text("s2<<SEP>>s1 s0<<SEP>>merge<<SEP>>2024-01-02T00:00:00+00:00<<REC>>\ns1<<SEP>><<SEP>>root<<SEP>>2024-01-01T00:00:00+00:00<<REC>>\nbad<<SEP>>x<<REC>>\n")
    rows = readers.read_commit_log(spark, str(tmp_path / "one.log")).orderBy("log_pos").collect()
    assert [(r.repo, r.sha, r.parents, r.message) for r in rows] == [("one", "s2", ["s1", "s0"], "merge"), ("one", "s1", [], "root")]
    (tmp_path / "tags.log").write_text("d1<<SEP>>body\nOriginal: x<<SEP>>rest<<REC>>nothing<<REC>>")
    assert [(r.sha, r.body) for r in readers.read_tagged_log(spark, str(tmp_path / "tags.log")).collect()] == [("d1", "body\nOriginal: x<<SEP>>rest")]
    (tmp_path / "state.json").write_text('{"version": 1, "shaMap": {"a": "b"}}')
    (tmp_path / "broken.json").write_text("{nope")
    step = {"originalSha": "a", "stepSha": "b", "model": "opus", "costUsd": 0.5, "timestamp": "2024-01-01T00:00:00.000Z"}
    whole = {"version": 1, "rootCommit": "a", "config": {"windowSize": 5, "reconciliation": {"strategy": "none"}}, "segments": [{"id": "trunk-0", "type": "trunk", "commits": ["a", "c"], "dependsOn": []}, {"id": "trunk-1", "type": "trunk", "commits": ["d"], "dependsOn": ["trunk-0"]}]}
    whole |= {"segmentProgress": {"trunk-0": {"status": "in-progress", "completedSteps": [step], "currentSpec": "s", "currentChangelog": "l"}}, "shaMap": {"a": "b"}, "headSha": "b", "totalSteps": 1, "totalCostUsd": 0.75}
    whole |= {"completedMerges": [{"mergeSha": "d", "stepSha": "e", "trunkSegmentId": "trunk-0", "branchSegmentId": "branch-0"}], "reconciliations": [{"atStep": 1, "atSha": "a", "model": "opus", "costUsd": 0.25, "findingsCount": 3, "skipped": False}]}
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "one.json").write_text(json.dumps(whole))
    state = readers.read_state(spark, str(tmp_path / "whole"), "stepSha", "headSha")
    assert [(r.repo, r.branchHead, r.totalSteps, r.config["windowSize"]) for r in state.collect()] == [("one", "b", 1, "5")]
    assert [tuple(r)[:7] for r in readers.steps_of_state(state, "stepSha").collect()] == [("one", "trunk-0", 0, "a", "b", "opus", 0.5)]
    assert [(r.segment_id, r.n_commits, r.status) for r in readers.segments_of_state(state).orderBy("creation_ord").collect()] == [("trunk-0", 2, "in-progress"), ("trunk-1", 1, "pending")]
    assert [tuple(r)[:5] for r in readers.merges_of_state(state, "stepSha").collect()] == [("one", "d", "e", "trunk-0", "branch-0")]
    assert [tuple(r)[:7] for r in readers.reconciliations_of_state(state).collect()] == [("one", 1, "a", "opus", 0.25, 3, False)]
    for name, text in {"r1/a/b.txt": b"x", "r1/a-b.txt": b"y", "r1/B.txt": b"\xff", "r2/it's \\.md": b"z"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(text)
    tree = readers.read_source_tree(spark, str(tmp_path / "tree")).orderBy("repo_id", "file_ord").collect()
    assert [tuple(r) for r in tree][:3] == [("r1", 0, "B.txt", None), ("r1", 1, "a-b.txt", "y"), ("r1", 2, "a/b.txt", "x")] and tree[3].content == "z"
    edges = spark.createDataFrame([(1, "c2", ["c1", "c0"]), (1, "c0", [])], "repo_id long, sha string, parents array<string>")
    pairs = spark.createDataFrame([(1, "c1", "c2", "first"), (1, "c0", "c2", "second"), (1, None, "c0", "root")], "repo_id long, from_sha string, to_sha string, diff string")
    assert sorted((r.to_sha, r.diff) for r in readers.diffs_of_commits(edges, pairs).collect()) == [("c0", "root"), ("c2", "first")]
    modules = spark.createDataFrame([("packages/a.md",)], "module_path string")
    assert readers.spec_file_map(modules).first().output_path == "spec/packages/a.md"
    assert [tuple(r) for r in readers.sha_map_of_state(readers.read_state(spark, str(tmp_path / "*.json"))).collect()] == [("state", "a", "b")]
    files = spark.createDataFrame([(1, "s", "spec/_master.md", " text "), (1, "s", "changelog.md", "log"), (2, "s", "spec/_master.md", "x"), (2, "s", "spec/m.md", "y"), (3, "s", "other", "z"), (4, "s", "spec.md", "\n\u00a0 one\ntwo\r\n"), (4, "s", "changelog.md", " kept\n"), (5, "s", "spec/_master.md", "m\n"), (5, "s", "spec/deep/m.md", "y"), (5, "s", "spec/notes.txt", "y")], "repo_id long, sha string, path string, content string")
    assert {r.repo_id: (r.spec, r.changelog, r.error) for r in readers.read_spec_versions(files).collect()} == {1: ("text", "log", None), 2: (None, "", "modules"), 3: (None, "", "missing"), 4: ("one\ntwo", " kept\n", None), 5: ("m", "", None)}
    readers.write_outputs(files, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_triggers_and_streams(spark, tmp_path):
    steps = [(r, k, [300, 500, 200, 900, 100][k % 5], f"{r}-{k}") for r in (1, 2) for k in range(1, 12)]
    table = spark.createDataFrame(steps, "repo_id long, step_no long, diff_tokens long, sha string").coalesce(1)
    batch = {(r.repo_id, r.step_no): r.fires for r in triggers.trigger_token_count(table, 800).collect()}
    assert [batch[1, k] for k in range(1, 6)] == [False, False, True, False, False]
    with pytest.raises(ValueError):
        triggers.make_trigger("other")
    folder = str(tmp_path / "steps")
    table.where("step_no <= 6").write.parquet(folder)
    read = lambda: spark.readStream.schema(table.schema).parquet(folder)
    outs = {"fires": streams.stream_token_trigger(read(), 800), "windows": streams.stream_commit_windows(read().selectExpr("repo_id", "'s' AS segment_id", "step_no AS ordinal", "sha"), 3)}
    for half in ("step_no > 99", "step_no > 6"):
        table.where(half).write.mode("append").parquet(folder)
        for name, out in outs.items():
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-c").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
    assert {(r.repo_id, r.step_no): r.fires for r in spark.read.parquet(f"{tmp_path}/fires").collect()} == batch
    rows = table.selectExpr("repo_id", "'s' AS segment_id", "step_no AS ordinal", "sha")
    want = {(r.repo_id, r.ordinal): r.window for r in windows.commit_windows(rows, 3).collect()}
    assert {(r.repo_id, r.ordinal): r.window for r in spark.read.parquet(f"{tmp_path}/windows").collect()} == want


def test_stream_ledger(spark, tmp_path):
    rows = [(1, k % 4, "2024-01-01", "s", k % 4, f"o{k % 2}", f"d{k % 4}", 0.5, f"spec {k % 4}", "log") for k in range(8)]
    events = spark.createDataFrame(rows, "repo_id long, event_id long, day string, segment_id string, seq long, original_sha string, derived_sha string, cost double, spec string, changelog string").withColumn("ts", F.to_timestamp("day"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart resumes and adds nothing
        streams.stream_ledger(stream, str(tmp_path / "out"), str(tmp_path / "c"), views=str(tmp_path / "views")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == 4
    totals, lineage, progress = streams.ledger_views(spark, str(tmp_path / "views"))
    assert [(r.repo_id, r.total_steps, float(r.total_cost)) for r in totals.collect()] == [(1, 4, 2.0)]
    assert sorted((r.original_sha, r.derived_sha) for r in lineage.collect()) == [("o0", "d2"), ("o1", "d3")]
    assert [tuple(r) for r in progress.collect()] == [(1, "s", 4, "spec 3", "log", "in-progress")]


def test_ledger(spark):
    log = spark.createDataFrame([(1, "d3", 0, "x"), (1, "d2", 1, "Original: " + "a" * 40), (1, "d1", 2, "Original: " + "a" * 40)], "repo_id long, sha string, log_pos long, body string")
    assert [tuple(r) for r in ledger.find_anchor(log).select("anchor", "commits_beyond_anchor", "error").collect()] == [("d2", 1, None)]
    assert [r.derived_sha for r in ledger.sha_map_from_log(log).collect()] == ["d2"]
    assert ledger.find_anchor(log.where("log_pos = 0")).first().error == "no anchor"
    steps = spark.createDataFrame([(1, "s", 0, "a"), (1, "s", 1, "c")], "repo_id long, segment_id string, seq long, original_sha string")
    members = spark.createDataFrame([(1, "s", 0, "a"), (1, "s", 1, "b")], "repo_id long, segment_id string, ordinal long, sha string")
    assert [r.valid for r in ledger.valid_prefix(steps, members).collect()] == [False]
    assert ledger.reset_segments(steps, members.select("repo_id", "segment_id").distinct()).count() == 0


def test_resume(spark):
    repos = spark.createDataFrame([(k, 10, 2, 8) for k in (1, 2, 3)], "repo_id long, total_commits long, n_segments long, total_steps long")
    states = spark.createDataFrame([(1, 5, 0.5)], "repo_id long, total_steps long, total_cost double")
    anchors = spark.createDataFrame([(1, "d", 4), (2, "d", 3), (3, None, None)], "repo_id long, anchor string, commits_beyond_anchor long")
    seeded = spark.createDataFrame([(2, "trunk-0", 2), (2, "trunk-1", 1)], "repo_id long, segment_id string, n_done long")
    found = ledger.resume_mode(repos, states, anchors, seeded).orderBy("repo_id").collect()
    assert [tuple(r)[1:] for r in found] == [("state-file", 10, 2, 5, 3, 0.5, None), ("derived-branch", 10, 2, 3, 5, 0.0, 3), ("fresh", 10, 2, None, None, None, None)]
