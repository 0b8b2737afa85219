"""Phrase mining against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from chronoloom.llm import phrases as ph

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, k string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, longest=4, least=30):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    kept = {p: f for p, f in count.items() if len(p) > 2 and f >= least}
    held = {(p[0], *p[1:][i : i + n]) for p in kept for n in range(2, len(p) - 1) for i in range(len(p) - n) if 100 * kept[p] >= 80 * kept[(p[0], *p[1:][i : i + n])]}
    out = collections.defaultdict(list)
    for p, a in kept.items():
        if p not in held:
            cuts = [(2000000 * a // (count[p[: k + 1]] + count[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), count[p[: k + 1]], count[(p[0], *p[k + 1 :])]))
    return {(lang, r + 1): (x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, found in out.items() for r, x in enumerate(sorted(found)[:top])}


def sample():
    rng = random.Random(3)
    words = ["the", "of", "New", "york", "CITY", "État", "ÉTAT", "naïve", "x y", "\x1c", "zebra", "a", "ß", "😀"]
    common = ["the United states of America", "as a matter of fact", "Ünder the sea"]
    rows = [("en", None), (None, ""), ("de", " \t.\n!"), (None, "one"), ("fr", "a " * 400), ("", "b c " * 60), ("en", "the same line. " * 3000)]
    for k in range(160):
        text = []
        for _ in range(rng.randrange(3, 40)):
            text += [rng.choice(common)] if rng.random() < 0.3 else rng.choices(words, k=rng.randrange(1, 6))
            text.append(rng.choice(["", "", ".", ",", "\n", "\v", "\t", " ;", "?!"]))
        rows.append((["en", "de", None, "en"][k % 4], rng.choice([" ", "  "]).join(text)))
    return rows + rows[:20]


@pytest.mark.parametrize("block", [1 << 19, 50])
@pytest.mark.parametrize("top,least", [(2000, 30), (7, 3)])
def test_collocations(spark, monkeypatch, block, top, least):
    monkeypatch.setattr(ph, "BLOCK", block)
    monkeypatch.setattr(ph, "RANGE", 1 << 21 if block > 50 else 100)
    rows = sample()
    df = spark.createDataFrame([(k % 7, t, lang, "x", 1, "y") for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    found = ph.collocations(df, top, least=least).collect()
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found}
    assert len(got) == len(found) and got == brute(rows, top, least=least)
    assert len({k[0] for k in got}) >= 3


def test_empty(spark):
    assert ph.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_survive_collisions(spark, monkeypatch):
    """Groups are only found by hashes; with hashes of two bits all groups are thought frequent, and the counts stay exact."""
    monkeypatch.setattr(ph, "_group", lambda hashes, left, right, k: (hashes[left] & np.uint64(3)) << np.uint64(61))
    rows = sample()[:60]
    df = spark.createDataFrame([(0, t, lang, "x", 1, "y") for lang, t in rows], SCHEMA)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in ph.collocations(df, 50, least=10).collect()}
    assert got == brute(rows, 50, least=10)


def test_wide_products(spark):
    from pyspark.sql import functions as F

    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    rows = [(9_000_000_000_000_000_000, 9_000_000_000_000_000_007, 9_100_000_000_000_000_000), (3, 4, 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, l long, r long").select(score).collect()]
    assert got == [2000000 * a // (l + r) for a, l, r in rows]
