"""Every operator against a brute-force version, with nulls, empty tables, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from chronoloom.llm import bpe, decontaminate, fm_index, jaccard, langid, line_dedup, quality, sharding, substring, token_counts, topk
from chronoloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, shard int, rank string"


def frame(spark, texts, langs=None, sources=None, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s0"] * len(texts))[k], len(t or ""), 7, 7, 7, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, n, vocabulary=200, line=12):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared = prose(rng, 60, 5000)
    texts = [None, "", " \n\t ", "one", "two words", "one", "ab " * 200]
    for k in range(40):
        text = prose(rng, rng.randrange(20, 160), 3000)
        texts.append(text)
        if k % 4 == 0:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts += [text, " ".join(words), text + "\n" + shared, shared + "\n" + text + "\n" + shared]
        if k % 5 == 0:
            words = text.split(" ")
            del words[rng.randrange(len(words))]
            texts.append(" ".join(words))
    texts.append(prose(rng, 9000, 40))
    base = prose(rng, 150, 3000).split(" ")
    for _ in range(260):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    return texts


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.3, (900, 8)).astype(np.float32)
    vectors[100:400] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v], "x", 3) for i, v in enumerate(vectors)]
    rows += [(1000, None, "x", 3), (1020, [1.0, None] + [0.0] * 6, "x", 3), (1040, [float("nan")] * 8, "x", 3), (1060, [float("inf")] * 8, "x", 3), (None, [1.0] * 8, "x", 3)]
    rows += [(1080, [], "x", 3), rows[20], rows[21], (21, rows[500][1], "x", 3), (40, rows[500][1], "x", 3)]  # an empty vector; repeated ids, with one and with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, block int").repartition(4)
    used = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    used = [(i, np.pad(v, (0, 8 - len(v)))) for i, v in used]
    scores = np.stack([v for _, v in used]) @ np.stack([v for _, v in used]).T
    want = []
    for q, (i, _) in enumerate(used):
        if i % 20 == 0:
            best = sorted((-int(scores[q, c]), used[c][0]) for c in range(len(used)) if c != q)[:20]
            want += [(i, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    found = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, shard_rows=300, block_rows=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(want)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.exact_top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_line_dedup(spark, corpus):
    docs = frame(spark, corpus)
    seen, want, order = {}, {}, []
    for i, text in enumerate(corpus):
        for k, line in enumerate((text or "").split("\n")):
            words = line.split()
            if not words:
                continue
            key = tuple(words)
            if key in seen:
                want[i, k] = (*seen[key], 0)
            else:
                seen[key] = (i, k)
                near = [at for at, other in order if len(words) >= 8 and len(other) >= 8 and line_dedup.one_edit([w.encode() for w in words], [w.encode() for w in other])]
                if near:
                    want[i, k] = (*min(near), 1)
                order.append(((i, k), words))
    found = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no, r.edits) for r in line_dedup.repeated_lines(docs).collect()}
    assert found == want and any(v[2] for v in want.values())
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    for i, text in enumerate(corpus):
        kept = "\n".join(x for k, x in enumerate((text or "").split("\n")) if (i, k) not in want)
        assert left.get(i, "gone") == (None if text is None else kept) or (i not in left and not kept.strip())
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns


def test_line_dedup_shared_ids(spark):
    rng = random.Random(12)
    texts, ids = [], []
    for k in range(60):
        doc_id = None if k % 3 else 5 if k % 2 else k
        lines = prose(rng, 60, 5000).split("\n")
        if k > 10:  # line 2 of an earlier row, with a word changed or as it is, at the same place
            words = texts[rng.randrange(k)].split("\n")[2].split(" ")
            if k % 4:
                words[rng.randrange(len(words))] = f"z{k}"
            lines[2] = " ".join(words)
        texts.append("\n".join(lines))
        ids.append(doc_id)
    docs = frame(spark, texts, ids=ids)
    at = {r.text: (line_dedup.LAST if r.doc_id is None else r.doc_id, r.th) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    lines = sorted((at[t][0], k, at[t][1], line.encode().split()) for t in texts for k, line in enumerate(t.split("\n")))
    seen, want = [], {}
    for doc_id, k, th, words in lines:
        same = [o[:2] for o in seen if o[3] == words]
        near = [o[:2] for o in seen if line_dedup.one_edit(o[3], words) and len(words) >= 8 and len(o[3]) >= 8]
        if same:
            want[doc_id, k, th] = (*same[0], 0)
        else:
            if near:
                want[doc_id, k, th] = (*near[0], 1)
            seen.append((doc_id, k, th, words))
    shown = lambda x: None if x == line_dedup.LAST else x
    found = collections.Counter(tuple(r) for r in line_dedup.repeated_lines(docs).collect())
    assert found == collections.Counter((shown(d), k, shown(w[0]), *w[1:]) for (d, k, _), w in want.items())
    kept = collections.Counter((ids[i], "\n".join(x for k, x in enumerate(t.split("\n")) if (at[t][0], k, at[t][1]) not in want)) for i, t in enumerate(texts))
    assert collections.Counter((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(docs).collect()) == kept
    assert {w[2] for (d, *_), w in want.items() if d == line_dedup.LAST} == {0, 1}


def test_one_edit():
    assert line_dedup.one_edit([b"a", b"b"], [b"a", b"c"]) and line_dedup.one_edit([b"a"], [b"a", b"b"]) and line_dedup.one_edit([b"b", b"a"], [b"a"])
    assert not line_dedup.one_edit([b"a"], [b"a"]) and not line_dedup.one_edit([b"a", b"b"], [b"b", b"a"]) and not line_dedup.one_edit([b"a"], [b"a", b"b", b"c"])


def test_quality(spark):
    rng = random.Random(2)
    good = [prose(rng, 80, 400) for _ in range(240)]
    bad = [" ".join(f"w{rng.randrange(9)} " * 6 for _ in range(14)) for _ in range(80)]
    texts = [*good, *bad, None, ""]
    docs = frame(spark, texts).withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i < 240), 0) for i in range(320)] + [(999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(found) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(320) if found[i].held_out]
    assert sum(found[i].predicted == int(i < 240) for i in held) >= 0.95 * len(held)
    assert quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_brute_force(spark):
    """Word vectors, pooling, the network's answer and the calibration, each against plain Python."""
    rng = random.Random(8)
    plain = [prose(rng, 60, 300) for _ in range(50)]
    texts = [*plain, *(" ".join(f"W{rng.randrange(9)} " * 4 for _ in range(9)) for _ in range(30)), "LOUD loud loud, loud", None, "", "one", plain[0], "x y " * 30_000]
    docs = frame(spark, texts)
    places, signs = quality.index_vectors()
    lists = [quality.tokens(t).tolist() for t in texts]
    assert lists[80].count(quality.CAPS) == 1 and lists[80].count(quality.AGAIN) == 2
    sums = collections.defaultdict(lambda: [0.0] * quality.WIDTH)
    for ids in lists:
        for i, own in enumerate(ids):
            for other in ids[max(0, i - 2) : i] + ids[i + 1 : i + 3]:
                for place, sign in zip(places[other], signs[other]):
                    sums[own][place] += sign
    unit = {w: [x / max(math.sqrt(sum(y * y for y in v)), 1e-9) for x in v] for w, v in sums.items()}
    vectors = quality.word_vectors(docs)
    assert all(np.allclose(vectors[w], v, atol=1e-5) for w, v in unit.items()) and not vectors[[w for w in range(quality.BUCKETS) if w not in unit]].any()
    zero = [0.0] * quality.WIDTH
    mean = [[sum(col) / len(ids) for col in zip(*(unit.get(w, zero) for w in ids))] if ids else zero for ids in lists]
    assert np.allclose(quality.pooled(texts, vectors), mean, atol=1e-5)

    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(80)], "doc_id long, quality int")
    rows = sorted((quality.pooled([texts[i]], vectors)[0].tobytes(), int(i < 50)) for i in range(80) if zlib.crc32(str(i).encode()) % 5)
    x, y = np.stack([np.frombuffer(r, np.float32) for r, _ in rows]).astype(float), np.array([float(q) for _, q in rows])
    net = quality.Network(x, y)
    w1, b1, w2, b2 = net.p

    def score(row):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, w1[:, k])) + b1[k]) for k in range(len(b1))]
        return 1 / (1 + math.exp(-max(-30, min(30, (sum(h * w for h, w in zip(hidden, w2)) + float(b2)) / net.temperature))))

    found = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert all(abs(found[i] - score(mean[i])) < 1e-3 for i in range(len(texts))) and found[84] == found[0]
    assert all((found[i] >= 0.3) == (i < 50) for i in range(80)) and 0.25 <= net.temperature <= 8


@pytest.mark.parametrize("hot", [0, 100])
def test_substring(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(substring.repeated_spans, "__defaults__", (hot,))
    texts = [*corpus, corpus[-1]]
    ids = [*range(len(corpus)), len(corpus) - 1]  # a repeated row
    counts = collections.Counter()
    words = [(t or "").split() for t in texts]
    for w in words:
        counts.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    want = []
    for i, w in zip(ids, words):
        gone = set()
        for p in range(len(w) - 34):
            if counts[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    found = [tuple(r) for r in substring.remove_repeats(frame(spark, texts, ids=ids)).collect()]
    assert sorted(found) == sorted(want) and sum(w[3] for w in want)
    assert substring.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = rng.integers(1, 5, 300)
        text[-1] = 0
        index = fm_index.FMIndex(text, 301)
        for m in (1, 2, 4):
            start = rng.integers(0, 290, 50)
            lo, hi = np.zeros(50, int), np.full(50, 300)
            for step in range(m):
                lo, hi = index.extend(text[start + m - 1 - step], lo, hi)
            want = [sum((text[i : i + m] == text[s : s + m]).all() for i in range(300 - m + 1)) for s in start]
            assert (hi - lo).tolist() == want


def test_decontamination(spark):
    rng = random.Random(4)
    items = [prose(rng, n, 900, 50) for n in (5, 8, 20, 40, 70)] + ["too few words", "w1 w2", None, "", " \n"]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, h int")
    texts = [prose(rng, 300, 900) for _ in range(30)] + [None, "", "a b", "these are\ttoo FEW words", "too few", "w1 w2 w3", prose(rng, 40_000, 9000) + " " + items[2]]
    for k in range(5):
        texts[k] = f"{texts[k]} {items[k].upper()} {texts[k]}"
        words = items[k].split()
        words[len(words) // 2] = "other"
        texts[10 + k] = f"{texts[10 + k]}\n{' '.join(words)} {texts[10 + k]}"

    def grams(text, k=5):
        w = (text or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for k, b in enumerate(items):
        size = min(5, len((b or "").split()))
        for i, t in enumerate(texts):
            if size and 100 * (shared := len(grams(t, size) & grams(b, size))) >= 80 * len(grams(b, size)):
                want[i, k] = shared
    assert len(want) >= 8 and (33, 5) in want and (35, 6) in want
    for rows in (500_000, 3):  # broadcast, then shuffled
        found = decontaminate.contained_items(frame(spark, texts), bench, broadcast_rows=rows).collect()
        assert {(r.doc_id, r.item_id): r.n_shared for r in found} == want
    assert decontaminate.contained_items(frame(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contained_items(frame(spark, texts), bench.limit(0)).count() == 0
    rows = [(None, texts[2]), (None, texts[2]), (None, texts[9]), (7, texts[0]), (7, texts[0]), (7, texts[1])]
    found = decontaminate.contained_items(frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]), bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 2), *sorted((7, k) for i, k in want if i < 2)]


def test_decontamination_sketch_searches(spark, monkeypatch):
    """A pair whose sketch isn't hit is never counted: without sketch values there are no candidates."""
    item = prose(random.Random(14), 40, 900, 50)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [item, f"x {item} y", "other words " * 9])
    hits, made = decontaminate._hits, []

    def watched(*args):
        made.append(hits(*args).count())
        return hits(*args)

    monkeypatch.setattr(decontaminate, "_hits", watched)
    n, m = 36, 63 - 51 + 1  # shingles of the item, values of its sketch
    assert decontaminate.contained_items(docs, bench).count() == 2 and made == [2 * m, 2 * n]
    sketches = decontaminate.sketches
    monkeypatch.setattr(decontaminate, "sketches", lambda *a: sketches(*a).withColumn("in_sketch", F.lit(False)))
    made.clear()
    assert decontaminate.contained_items(docs, bench).count() == 0 and made == [0, 0]


def shingle_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return sets


def brute_components(sets):
    """For each set the smallest index that links reach."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("small", [20, 100, 600])
def test_jaccard(spark, corpus, small, monkeypatch):
    monkeypatch.setattr(jaccard.jaccard_links, "__defaults__", (small, 600_000, 64))
    sets = shingle_sets(corpus)
    root = brute_components(sets)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, corpus)).collect()}
    assert found == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.jaccard_components(frame(spark, corpus).limit(0)).count() == 0


@pytest.mark.parametrize("small", [10, 600])
def test_jaccard_chains(spark, small, monkeypatch):
    """Families without a centre, in one large region: links only between neighbours of a chain of edits."""
    monkeypatch.setattr(jaccard.jaccard_links, "__defaults__", (small, 600_000, 8))
    rng = random.Random(21)
    texts = []
    for _ in range(3):
        words = prose(rng, 120, 4000).split()
        for k in range(70):
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words) - 30)] = f"z{rng.randrange(10_000)}"
            texts.append(" ".join(words[: len(words) - rng.randrange(3)]))
    texts += [" ".join(t.split()[-40:]) for t in texts[::9]]
    sets = shingle_sets(texts)
    root = brute_components(sets)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert found == dict(enumerate(root)) and 5 < len(set(root)) < len(texts)


@pytest.mark.parametrize("shared", [170, 176, 184])
def test_jaccard_boilerplate(spark, shared, monkeypatch):
    """Pages about the threshold that share most of their words: parted by what they don't share, and few copies of each."""
    monkeypatch.setattr(jaccard.jaccard_links, "__defaults__", (20, 600_000, 64))
    rng = random.Random(shared)
    core = prose(rng, shared, 50_000).split()
    section = prose(rng, 8, 50_000).split()
    texts = []
    for k in range(260):
        own = prose(rng, rng.choice((200, 200, 200, 190, 215)) - shared, 50_000).split()
        page = core[: shared // 2] + (section + own[8:] if k % 3 == 0 else own) + core[shared // 2 :]
        if k % 7 == 0:
            page[rng.randrange(len(core) // 2)] = "changed"
        texts.append(" ".join(page))
        if k % 10 == 0:
            page[-1] = "other"
            texts.append(" ".join(page))
    moved = []

    def joined(members, real=jaccard._joined):
        moved.append(members)
        return real(members)

    monkeypatch.setattr(jaccard, "_joined", joined)
    monkeypatch.setattr(jaccard, "released", lambda *tables: None)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert found == dict(enumerate(brute_components(shingle_sets(texts))))
    if shared == 170:
        assert len(set(found.values())) > 200
        assert sum(m.count() for m in moved) < 4 * len(texts)


def test_jaccard_row_keys(spark):
    """Links through rows without a doc_id, rows of one doc_id with different texts, repeated rows, one very long text."""
    rng = random.Random(22)
    words = prose(rng, 100, 4000).split()
    chain = [words, [*words[:50], "x", *words[51:]], [*words[:50], "x", *words[51:75], "y", *words[76:]]]
    chain[2] = [*chain[2][5:], "z"]
    a, b, c = (" ".join(w) for w in chain)
    other, long = prose(rng, 80, 4000), prose(rng, 60_000, 50_000)
    rows = [(1, a), (None, b), (3, c), (4, other), (4, a), (7, other + " more"), (4, other), (4, other), (9, long), (8, long + " end"), (None, "alone in its class"), (None, None), (5, "")]
    texts = [t for _, t in rows]
    root = brute_components(shingle_sets(texts))
    least = {r: min((i for (i, _), s in zip(rows, root) if s == r and i is not None), default=None) for r in root}
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts, ids=[i for i, _ in rows])).collect())
    assert found == collections.Counter((i, len(s), least[r]) for (i, _), s, r in zip(rows, shingle_sets(texts), root))
    assert found[3, len(shingle_sets([c])[0]), 1] == 1 and found[4, len(shingle_sets([other])[0]), 4] == 3


def test_region_links_sides():
    rng = random.Random(23)
    for _ in range(40):
        base = [rng.sample(range(60), 40) for _ in range(2)]
        sets = [np.unique(np.array([x for x in rng.choice(base) if rng.random() < 0.93] + rng.sample(range(60, 90), 2), np.uint64)) for _ in range(24)]
        side = np.array([k % 2 for k in range(24)])
        label = np.array([rng.choice([-1, -1, 0, 1]) for _ in range(24)])
        want = [(i, j) for i in range(24) for j in range(i) if side[i] != side[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

        def parts(edges):
            root = [100 + x if x >= 0 else k for k, x in enumerate(label)]
            for i, j in edges:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        assert parts(jaccard.region_links(sets, side, label)) == parts(want)


def test_region_links_recursion():
    rng = random.Random(6)
    for _ in range(30):
        base = [rng.sample(range(60), 40) for _ in range(3)]
        sets = [np.unique(np.array([x for x in rng.choice(base) if rng.random() < 0.9] + rng.sample(range(60, 90), 2), np.uint64)) for _ in range(25)]
        want = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for a in sets] for b in sets]

        def parts(edges):
            root = list(range(len(sets)))
            for i, j in edges:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        assert parts(jaccard.region_links(sets)) == parts([(i, j) for i in range(25) for j in range(i) if want[i][j]])


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200, 240)] + [(0, k) for k in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = root[a], root[b]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    found = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == {k: v for k, v in root.items() if k in linked}


ODD = ["a  b ", "▁ ▁▁x", "x" * 500, "àb ̈c", "<|startoftext|>Hi <|endoftext|>", "<s> hi </s>", "Été 'll don't 12345 ½ ΣΑΣ İst", "　x\xa0y\x1cz\x85q", "日本語 😀😀", "\x00a", "ﬁ é", "\n", "a" + "̈" * 9]


def odd_texts():
    rng = random.Random(8)
    letters = "ab é̈Σ'Ls<|>▁ \n\t\xa0 é1²😀ﬁ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["".join(rng.choice(letters) for _ in range(900)) for _ in range(20)]
    return [None, "", *ODD, *made, prose(rng, 3000), prose(rng, 3000)]


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    texts = odd_texts()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    found = {r.doc_id: r for r in bpe.bpe_encode(frame(spark, texts), path).collect()}
    digests = {r.doc_id: r for r in bpe.bpe_digests(frame(spark, texts), path).collect()}
    for i, ids in enumerate(want):
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i].ids == ids and found[i].decoded == decoded and found[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.bpe_encode(frame(spark, texts).limit(0), path).count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts()
    found = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), path, limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 100)


def test_sharding_repeats(spark, monkeypatch):
    """Nine rows of ten are equal and without a doc_id: no bucket holds much more than another."""
    most = []

    def positions(rows, *args, real=sharding._positions, **more):
        most.append(rows.groupBy("stratum", "b").count().agg(F.max("count")).first()[0])
        return real(rows, *args, **more)

    monkeypatch.setattr(sharding, "_positions", positions)
    ids, texts = [None] * 3600 + list(range(400)), ["same"] * 3600 + [f"text {i}" for i in range(400)]
    rows = sharding.stratified_shards(frame(spark, texts, ids=ids), bucket_rows=40).collect()
    assert max(most) < 100
    assert collections.Counter((r.doc_id, r.text_crc32) for r in rows) == collections.Counter((i, zlib.crc32(t.encode())) for i, t in zip(ids, texts))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(slots) == 8 and all(sorted(x) == list(range(500)) for x in slots.values())
    again = sharding.stratified_shards(frame(spark, texts, ids=ids).repartition(7), bucket_rows=40).collect()
    assert collections.Counter(rows) == collections.Counter(again)


def test_sharding(spark, corpus):
    rng = random.Random(9)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in corpus]
    rows = sharding.stratified_shards(frame(spark, corpus, sources=sources), bucket_rows=8).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(corpus)]
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    total = collections.Counter(sources)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        for s, n in total.items():
            assert abs(sum(r.source == s for r in part) - n / 8) <= 2
    assert sharding.stratified_shards(frame(spark, corpus).limit(0)).count() == 0
    assert sharding.stratified_shards(frame(spark, corpus[:3])).count() == 3


def test_language(spark):
    rng = random.Random(10)
    vocab = {"en": "the of and to in is that with from this have", "de": "der die und nicht zu den mit sich auf für ist", "fr": "les des une dans que pour sur avec être après"}
    words = {k: v.split() for k, v in vocab.items()}
    langs = [rng.choice(list(words)) for _ in range(300)]
    texts = [" ".join(rng.choice(words[k]) for _ in range(rng.randrange(5, 60))) for k in langs] + [None, "", "123 ... 4", "the of and " * 40 + "der die und nicht " * 20]
    langs += [None, "en", None, None]
    docs = frame(spark, texts, langs=langs)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert sum(found[i].lang_pred == langs[i] for i in range(300)) >= 297
    assert [found[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and found[302].score == 0
    assert found[303].lang_pred == "en" and found[303].n_langs == 2 and 0.5 < found[303].score < 0.8
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in found.values())
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 301


def test_language_brute_force(spark):
    """Four-gram counts, EM and the penalised choice of the language set against plain Python."""
    rng = random.Random(12)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randrange(2, 7)))
    langs = [rng.choice(list(letters)) for _ in range(120)]
    texts = [" ".join(word(k) for _ in range(rng.randrange(3, 50))) for k in langs]
    for parts in (("aa", "bb"), ("bb", "cc"), ("aa", "bb", "cc"), ("cc",)):
        texts.append(" ".join(word(k) for k in parts for _ in range(60)))
    texts += [texts[0], "Abc Éfg", "7 7", " ".join(word("aa") for _ in range(20_000)), None]
    langs += [None] * (len(texts) - len(langs))

    def grams(text):
        data = b" " + text.lower().encode() + b"  "
        return collections.Counter((int.from_bytes(data[i : i + 4], "little") * 0x9E3779B1 % 2**32) >> 16 for i in range(len(data) - 3))

    counts = {k: collections.Counter() for k in letters}
    for i, (text, lang) in enumerate(zip(texts, langs)):
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(grams(text))
    size = {k: sum(c.values()) + 0.05 * langid.BUCKETS for k, c in counts.items()}
    chance = lambda k, g: (counts[k][g] + 0.05) / size[k]

    def em(found, p, theta, steps=8):
        for _ in range(steps):
            new = dict.fromkeys(theta, 0.0)
            for g, n in found.items():
                whole = sum(theta[k] * p[k][g] for k in theta)
                for k in theta:
                    new[k] += n * theta[k] * p[k][g] / whole
            theta = {k: v / sum(new.values()) for k, v in new.items()}
        return theta, sum(n * math.log(sum(theta[k] * p[k][g] for k in theta)) for g, n in found.items())

    def best(text):
        found = grams(text)
        p = {k: {g: chance(k, g) for g in found} for k in letters}
        alone = {k: sum(n * math.log(p[k][g]) for g, n in found.items()) for k in letters}
        top = max(alone, key=alone.get)
        choice = (alone[top], {top: 1.0})
        theta = em(found, p, dict.fromkeys(letters, 1 / 3))[0]
        order = sorted(letters, key=lambda k: -theta[k])
        for size in (2, 3):
            fitted, likelihood = em(found, p, {k: (theta[k] + 1e-6) / sum(theta[o] + 1e-6 for o in order[:size]) for k in order[:size]})
            choice = max(choice, (likelihood - 2.0 * math.log(sum(found.values()) + 1) * (size - 1), fitted), key=lambda c: c[0])
        return max(choice[1].items(), key=lambda kv: kv[1])

    found = {r.doc_id: r for r in langid.identify(frame(spark, texts, langs=langs)).collect()}
    for i, text in enumerate(texts):
        if text is None or text == "7 7":
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
        else:
            lang, share = best(text)
            assert found[i].lang_pred == lang and abs(found[i].score - share) < 5e-3, i
    assert found[120].n_langs == 2 and found[122].n_langs == 3 and found[123].n_langs == 1


def test_accepted_without_languages(spark):
    texts = ["some words", "123 ... 4", None, "", "été"]
    docs = frame(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {0, 4}


def test_accepted_by_proportions(spark):
    """The proportions decide: noise and unlearned languages go, mixtures and texts full of numbers stay."""
    rng = random.Random(21)
    vocab = {"en": "the of and to in is that with from this have", "de": "der die und nicht zu den mit sich auf für ist"}
    langs = [rng.choice(list(vocab)) for _ in range(200)]
    texts = [" ".join(rng.choice(vocab[k].split()) for _ in range(rng.randrange(5, 60))) for k in langs]
    alone = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 4 == 2)  # held out, so its language isn't learned
    cases = {"qq zz 12": False, "xkqj vvwz pqzx": False, "123 ...": False, "the of and der die und nicht " * 3: True, "this is the +1 669 555 7228 25.178.55.242": True, None: False, "": False}
    found = {"xx": (alone, "жук бежал вдоль реки", "xx")} | {i: (i, t, k) for i, (t, k) in enumerate(zip(texts, langs))} | {t: (1000 + i, t, None) for i, t in enumerate(cases)}
    long_id = 2000
    found[long_id] = (long_id, "the of and to " * 100_000, None)
    docs = spark.createDataFrame([*found.values(), (None, "the of and to in is", "en"), (None, None, None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("kept"))  # names that predict uses itself
    kept = langid.accepted(docs)
    assert kept.schema == docs.schema
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    wanted = [*range(200), *(found[t][0] for t, good in cases.items() if good), long_id]
    assert [i for null, i, _ in ids if not null] == sorted(wanted)
    assert [t for null, _, t in ids if null] == ["the of and to in is"]
    assert langid.accepted(docs.limit(0)).count() == 0
    assert langid.accepted(docs, least=0.0).count() == len(ids) + 3  # the texts of noise with a letter


def test_languages_bounded(spark):
    """The languages of most rows are learned, ties to the first in order; null ids take part like others."""
    docs = spark.createDataFrame([(None if i == 1 else i, f"text {lang} of some words", lang) for i, lang in enumerate("ccccbbbaaad")], "doc_id long, text string, lang string")
    assert langid.fit(docs)[0] == list("abcd")
    assert langid.fit(docs, most=2)[0] == ["a", "c"]


def test_bpe_repairs_joins():
    """Joins that disagree are encoded as one: a tokenizer whose words reach across white space would be right too."""
    coder = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(31)
    text = prose(rng, 4000, 3000)
    want = coder.raw([text.encode()])[0]
    assert coder.encode_all([text])[0] == want and len(coder.cut(text.encode())) > 5
    fresh = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    fresh.agreed = lambda seams: set()
    asked, raw = [], fresh.fresh
    fresh.fresh = lambda chunks: asked.extend(chunks) or raw(chunks)
    assert fresh.encode_all([text])[0] == want and asked == [text.encode()]


def test_language_memory():
    """The pipeline's language ID takes under 30 MB for 3 MB of texts (batches of 1 MB took 53 MB for 5 MB), with the same rows."""
    rng = random.Random(6)
    texts = [prose(rng, 300, 40_000) if k % 9 else "12 34" for k in range(1500)]
    table = np.random.default_rng(1).dirichlet(np.full(langid.BUCKETS, 0.3), 6) + 1e-9
    log_p = langid.with_noise([], np.log(table).astype(np.float32))[1]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    tracemalloc.start()
    found = [i for b in langid.fitting(iter([batch]), log_p, 0.1) for i in b.column(0).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    able = [i for i, t in enumerate(texts) if langid.has_letter(t)]
    share = langid.mixtures([texts[i] for i in able], log_p)[:, -1]
    assert batch.nbytes > 2 << 20 and most < 30e6 and found == [i for i, x in zip(able, share) if x <= 0.9]


def test_bpe_memory():
    """A word is kept in under 180 bytes, and words without ids are kept too (before: 255 bytes, now 124)."""
    coder = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    coder.known({b"warm"})
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(20_000)]
    tracemalloc.start()
    coder.known({w.encode() for w in words} | {b"\xc2\x85"})
    kept = tracemalloc.get_traced_memory()[0] / len(words)
    tracemalloc.stop()
    coder.raw = lambda parts: [1 / 0 for _ in parts]
    assert len(coder.known({w.encode() for w in words[:50]} | {b"\xc2\x85"})) == 51 and kept < 180


def test_spread_join(spark):
    from chronoloom.llm.common import hot_from, spread_join, written

    rows = spark.createDataFrame([(1, k) for k in range(500)] + [(k, k) for k in range(2, 90)] + [(None, 7)], "key long, x long").repartition(6, "x")
    values = written(rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("times")).where("key % 3 <> 0"))
    for bounds in ({"parts": 2}, {"parts": 1000}, {"parts": 1, "many": 100}, {"parts": 1, "many": 1, "most": 3}):
        joined = spread_join(rows, values, ["key"], **bounds)
        found = sorted((r.key, r.x, r.times) for r in joined.collect())
        assert found == sorted([(1, k, 500) for k in range(500)] + [(k, k, 1) for k in range(2, 90) if k % 3])
        tasks = [r["count"] for r in joined.where("key = 1").groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) == 6 and max(tasks) < 2 * sorted(tasks)[3]  # the rows of a hot key stay where they are
    assert spread_join(rows, values.limit(0), ["key"]).count() == 0
    assert hot_from(10**6) == 1000 and hot_from(10**10) == 10**6 and hot_from(10**13) == 2 * 10**7
    assert all(total / hot_from(total) <= 500_000 for total in (10**4, 10**9, 10**12, 10**15))


def test_line_dedup_moves_numbers(spark, monkeypatch):
    """Lines go by one number through the joins of halves and variants (before: 28 bytes of names), and the earliest stays."""
    moved = {}

    def joined(rows, values, keys, real=line_dedup.spread_join, **bounds):
        moved[keys[0]] = {f.name: f.dataType.simpleString() for f in [*rows.schema, *values.schema]}
        return real(rows, values, keys, **bounds)

    monkeypatch.setattr(line_dedup, "spread_join", joined)
    words = "one two three four five six seven eight nine".split()
    texts = {900: words, 7: [*words[:3], "x", *words[4:]], -5: [*words[:3], "y", *words[4:]], 20_000_000_000: words[:8], 31: [*words, "ten"], 8: ["a", *words]}
    docs = spark.createDataFrame([(k, "other\n" * (k == -5) + " ".join(w)) for k, w in texts.items()] + [(7, " ".join(words[1:]))], "doc_id long, text string").repartition(5)
    found = sorted(tuple(r) for r in line_dedup.repeated_lines(docs).collect())
    assert found == [(7, 0, -5, 1, 1), (900, 0, -5, 1, 1), (20_000_000_000, 0, 900, 0, 1)]
    assert moved["half"].keys() == {"number", "bit", "half", "times"} and moved["keys"].keys() == {"id", "kinds", "keys", "m0", "m1", "m2", "times"}
    assert {moved["keys"][k] for k in ("id", "m0", "m1", "m2")} == {"bigint"}


def test_line_dedup_hot_line(spark):
    """A line of nine tenths of all rows, its near variants and a half that all others share: the earliest stays."""
    hot = "one two three four five six seven eight nine"
    texts = [hot] * 270 + [f"one two three four five w{i} x{i} y{i} z{i}" for i in range(20)] + [hot.replace("nine", f"n{i}") for i in range(10)]
    ids = list(range(300, 0, -1))
    found = {(r.doc_id, r.line_no): (r.keep_doc_id, r.edits) for r in line_dedup.repeated_lines(frame(spark, texts, ids=ids)).collect()}
    # ids 1-10 are the near variants: 2-10 are one edit from 1; the hot lines, 31-300, are an edit from 1 or equal to 31
    assert {k[0] for k in found} == {*range(2, 11), *range(31, 301)}
    assert all(found[i, 0] == (1, 1) for i in range(2, 11)) and found[31, 0] == (1, 1)
    assert all(found[i, 0] == (31, 0) for i in range(32, 301))


def test_quality_sample_bounded(spark, monkeypatch):
    """Labelled ids that repeat count once in the sample; null ids are scored and have no label."""
    rng = random.Random(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = frame(spark, [prose(rng, 60) for _ in range(40)])
    again = once.unionByName(once.where("doc_id < 30")).unionByName(once.where("doc_id = 1").withColumn("text", F.lit("other")))
    again = again.unionByName(once.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    learned, begin = [], quality.Network.__init__
    monkeypatch.setattr(quality.Network, "__init__", lambda self, x, y: (learned.append(list(y)), begin(self, x, y))[1])
    found = quality.quality_scores(again, labels).collect()
    assert len(found) == 72 and [r.held_out for r in found if r.doc_id is None] == [False]
    kept = [i % 2 for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(learned[0]) == sorted(kept)


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    rng = random.Random(11)
    items = [prose(rng, 30, 5000, 99) for _ in range(3)]
    texts = [*corpus[:100], *(prose(rng, 50, 5000) + "\n" + x for x in items), "12 34"]
    base = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long"))
    base.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    seen, order, kept = {}, [], []
    for i, t in left:
        lines = []
        for line in t.split("\n"):
            w = line.encode().split()
            if w and (tuple(w) in seen):
                continue
            if w:
                seen[tuple(w)] = i
                near = len(w) >= 8 and any(len(o) >= 8 and line_dedup.one_edit(w, o) for o in order)
                order.append(w)
                if near:
                    continue
            lines.append(line)
        if "".join(lines).strip():
            kept.append((i, "\n".join(lines)))
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in kept}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    grams = [set(jaccard.shingles(x).tolist()) for x in items]
    want = {i: t for i, t in kept if root[i] == i and not any(100 * len(sets[i] & g) >= 80 * len(g) for g in grams)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r.ids for i, r in rows.items()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in want.items()}
    assert len(want) < len(kept) and not {100, 101, 102} & set(rows)


def test_pipeline_shared_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    items = [prose(rng, 30, 5000, 99) for _ in range(3)]
    one, two, three, four, five = (prose(rng, 60, 5000) for _ in range(5))
    rows = [(None, one), (None, one + " more"), (4, two), (None, two), (7, three), (8, three + " more"), (8, four), (9, five), (9, five), (None, None)]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    left = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert left in [collections.Counter([(None, t), (4, two), (7, three), (8, four), (9, five), (None, None)]) for t in (one, one + " more")]

    spark.createDataFrame([(1, items[0]), (1, items[1]), (None, items[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{one} {items[0]}"), (None, two), (3, f"{three} {items[1]}"), (3, four), (5, f"{five} {items[2]}")]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {(r.doc_id, r.text) for r in left.collect()} == {(None, two), (3, four)}


def test_repeated_rows_and_long_texts(spark):
    """Every row of a table that holds each twice gets the answer it gets alone; one text is very long."""
    rng = random.Random(21)
    long = prose(rng, 40_000, 9000)
    texts = [long, long + " end", prose(rng, 90, 3000), prose(rng, 90, 3000), None, "", "short one"]
    docs = frame(spark, texts, langs=["en", "de", "en", "de", None, "en", "en"])
    twice = docs.unionByName(docs)
    bpe_path, piece_path = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, " ".join(long.split()[30_000:30_040])), (1, "never seen in any of these texts")], "item_id long, text string")
    for run in (
        lambda d: bpe.bpe_digests(d, bpe_path),
        lambda d: token_counts.token_counts(d, piece_path),
        lambda d: langid.identify(d).select("doc_id", "held_out"),
        lambda d: jaccard.jaccard_components(d),
    ):
        assert sorted(map(tuple, run(twice).collect())) == sorted(2 * [tuple(r) for r in run(docs).collect()])
    found = decontaminate.contained_items(twice, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 0)}
    assert sorted(r.doc_id for r in quality.quality_scores(twice, labels).collect()) == sorted(2 * list(range(7)))
    assert len({(r.shard, r.slot) for r in sharding.stratified_shards(twice).collect()}) == 14
    kept = line_dedup.drop_repeated_lines(twice.where("doc_id = 2"))
    assert [r.text for r in kept.collect()] == 2 * [texts[2]]  # equal rows are one document
    empty = docs.limit(0)
    assert token_counts.token_counts(empty, piece_path).count() == 0 and decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0 and line_dedup.drop_repeated_lines(empty).count() == 0
