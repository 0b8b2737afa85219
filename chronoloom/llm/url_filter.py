"""URL filter (operator 12): rules first, then naive Bayes over words of host and path, host names cut into words by Viterbi.

Rules decide a url by host suffix and path prefix. What they decide is also what the method learns from: a multinomial naive
Bayes over words of hosts and another over words of paths, with even priors, since rules say nothing of how common blocked hosts
are elsewhere. Words that the rules themselves name, and the last label of a host, take no part: they would only carry the rules beyond where they
hold. Urls that no rule decides are the background: they count as allowed in learning, but for hosts with one of a few given words, whose
urls count as blocked in the model of hosts.

Host names run words together. A unigram model over the words of all pages gives every substring of a name its probability,
and Viterbi finds the best cut. The model grows with the corpus, so it isn't broadcast: the substrings of each different name
join it. Scores are made once for each different host and each different path without digits, and join the urls by keys of
which the hot ones are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread_join, texts_of, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words that mark an undecided host as an example of a blocked one.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: Letters of the longest word that a name is cut into; longer runs that are no word are cut here too.
LONGEST = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_WORD = re.compile(f"[a-z]{{2,{LONGEST}}}")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: host from after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"(?s)\A([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits, and its verdict; null where none fits. Of equal length, the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z]+"), lambda w: w != "")


def unigrams(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(word, n): words of the pages' texts outside tags, and words that hosts and paths write apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in small_batches(batches):
            for html in texts_of(batch, "html"):
                held.update(_WORD.findall(_TAGS.sub(" ", html).lower()))
            if len(held) > 200_000:
                yield told()
                held = Counter()
        yield told()

    texts = pages.where("html IS NOT NULL").select(F.col("html").cast("string")).mapInArrow(count, "word string, n long")
    apart = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    written_apart = urls.select(F.explode(F.concat(apart, words_of(F.col("path")))).alias("word")).where(F.col("word").rlike(rf"\A[a-z]{{2,{LONGEST}}}\z"))
    return texts.unionByName(written_apart.groupBy("word").agg(F.count("*").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))


def best_cut(name: str, spans: dict[str, int], total: int) -> list[str]:
    """The words of the most probable cut; of equal ones, the longer first words. A run that is no word costs a letter's share each."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = spans.get(name[start:end])
            p = best[start] + (math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10))
            if p > best[end] + 1e-9:
                best[end], back[end] = p, start
    out, at = [], len(name)
    while at:
        out.append(name[back[at] : at])
        at = back[at]
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of each different name: its substrings join the unigrams, and Viterbi runs on what they found."""
    total = words.agg(F.sum("n")).first()[0] or 1
    ends = F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))
    cuts = names.where("length(name) > 1").select("name", F.explode(F.sequence(F.lit(1), F.length("name") - 1)).alias("at")).select("name", F.explode(F.transform(ends, lambda k: F.substring(F.col("name"), F.col("at"), k))).alias("word")).distinct()
    found = cuts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            made = [best_cut(name, {x["word"]: x["n"] for x in spans or ()}, total) for name, spans in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], ["name", "words"])

    return names.join(found, "name", "left").select("name", "found").mapInArrow(cut, "name string, words array<string>")


def _weights(bags: DataFrame) -> DataFrame:
    """(word, w): the log-odds of blocking that naive Bayes with one added count gives each word of ``bags`` (allow, block, words)."""
    learned = written(bags.where("allow + block > 0").select("allow", "block", F.explode("words").alias("word")).groupBy("word").agg(F.sum("allow").alias("a"), F.sum("block").alias("b")))
    sums = learned.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    share = lambda c, n: F.log((F.col(c) + 1) / float((n or 0) + sums.v or 1))
    return learned.select("word", (share("b", sums.b) - share("a", sums.a)).alias("w"))


def _scored(bags: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, score, times): the sum of the weights of a bag's words."""
    found = bags.select(key, F.explode("words").alias("word")).groupBy(key, "word").agg(F.count("*").alias("k")).join(weights, "word")
    return bags.select(key, "times").join(found.groupBy(key).agg(F.sum(F.col("k") * F.col("w")).alias("score")), key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"), "times")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: tuple[str, ...] = SEEDS, threshold: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``.

    The verdict is the rule's; without a rule, ``block`` where naive Bayes gives blocking at least ``threshold``, else ``allow``.
    score is the log-odds of blocking (null where a rule decides). A null url, or one without ``://``, has an empty host and
    path and is allowed, as is all where nothing was learned. Repeated rows and page_ids are rows like others; null pages
    count no words; an empty table gives no rows; other columns are ignored. Hosts and paths are used whole.
    """
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    # digits part no paths, so that pages of one kind share a key
    urls = written(urls.withColumns({"rule": rule, "ruled": verdict, "kind": F.regexp_replace("path", "[0-9]+", "0")}))
    named = {w for _, h, p in rules for w in re.findall("[a-z]+", (h + p).translate(str.maketrans(_UPPER, _LOWER)))}
    told = lambda v: F.count_if(F.col("ruled") == v).alias(v)
    counts = [told("allow"), told("block"), F.count_if(F.col("ruled").isNull()).alias("times")]

    hosts = written(urls.groupBy("host").agg(*counts))
    names = hosts.select("host", F.posexplode(words_of(F.regexp_replace("host", r"\.[^.]*\z", ""))).alias("pos", "name"))
    cut = written(segmented(names.select("name").distinct(), written(unigrams(pages, urls))))
    kept = F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])), lambda w: ~w.isin(sorted(named)))
    bags = hosts.join(names.join(cut, "name").groupBy("host").agg(kept.alias("words")), "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    seeded = F.arrays_overlap("words", F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    bags = written(bags.withColumns({"block": F.col("block") + F.when(seeded, F.col("times")).otherwise(0), "allow": F.col("allow") + F.when(seeded, 0).otherwise(F.col("times"))}))
    kinds = written(urls.groupBy("kind").agg(*counts).withColumn("allow", F.expr("allow + times")).withColumn("words", F.filter(words_of(F.col("kind")), lambda w: ~w.isin(sorted(named)))))

    by_host, by_kind = (written(_scored(b, k, _weights(b))) for b, k in ((bags, "host"), (kinds, "kind")))
    open_urls = urls.where("rule IS NULL").select("page_id", "host", "path", "kind")
    scored = spread_join(open_urls, by_host.where("times > 0").withColumnRenamed("score", "h"), ["host"]).drop("times")
    scored = spread_join(scored, by_kind.where("times > 0").withColumnRenamed("score", "p"), ["kind"])
    score = F.round(F.col("h") + F.col("p"), 9)
    judged = F.when(score >= math.log(threshold / (1 - threshold)), "block").otherwise("allow")
    none = F.lit(None).cast("string")
    return urls.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(scored.select("page_id", "host", "path", none.alias("rule"), judged.alias("verdict"), score.alias("score")))
