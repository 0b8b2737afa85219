"""URL filter: rules and parts against plain Python, segmentation against all cuts, verdicts against a plain naive Bayes."""

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string, host string, verdict int, words string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate(ASCII), re.split("[?#]", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "https://EXAMPLE.com/en/1", "https://Www.Example.COM/en/1?x=/fr/", "http://sub.www.example.com/en/", "http://example.com", "http://example.com?/en/", "http://example.com/EN/2",
    "http://myexample.com/en/3", "http://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "ftp://net/es/", "http://x.org/en/a#b?c", "http://ÄB.org/É", "mailto:a://b.net/fr/x://y", "http://x.com:80/a", "://com/", "http://x.org\n/en", "http://a.net/es",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "<p>words here</p>", "x", 1, "y") for i, u in enumerate(URLS)] + [(3, URLS[5], None, "x", 1, "y")], SCHEMA)
    rows = uf.filter_urls(df).collect()
    want = sorted((i, *parts(u), str(rule_of(*parts(u))[0])) for i, u in [*enumerate(URLS), (3, URLS[5])])
    assert sorted((r.page_id, r.host, r.path, str(r.rule)) for r in rows) == want
    assert all(r.verdict == rule_of(r.host, r.path)[1] for r in rows if r.rule)
    assert uf.filter_urls(df.limit(0)).collect() == []
    null = uf.filter_urls(df.where("url IS NULL")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in null] == [("", "", None, "allow")]


def cost(word, spans, total):
    return math.log(spans[word] / total) if word in spans else math.log(10 / total) - len(word) * math.log(10)


def test_best_cut():
    rng = random.Random(1)
    for _ in range(200):
        name = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 10)))
        spans = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 5))): rng.randrange(1, 50) for _ in range(6)}
        best = -math.inf
        for n in range(len(name)):
            for at in itertools.combinations(range(1, len(name)), n):
                words = [name[a:b] for a, b in zip((0, *at), (*at, len(name)))]
                best = max(best, sum(cost(w, spans, 1000) for w in words))
        found = uf.best_cut(name, spans, 1000)
        assert "".join(found) == name and math.isclose(sum(cost(w, spans, 1000) for w in found), best)
    assert uf.best_cut("freebetsnow", {"free": 90, "bets": 20, "now": 50, "be": 500}, 10_000) == ["free", "bets", "now"]
    assert "".join(uf.best_cut("x" * 100, {}, 100)) == "x" * 100


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    words = ["garden", "river", "stone", "market", "music", "casino", "bets", "prize"]
    out = []
    for i in range(900):
        site = "".join(rng.sample(words[:5], 2)) if i % 3 else rng.choice(["casinoprize", "free-bets", "betsprize"])
        tld = rng.choice(["com", "net", "org", "example.com", "example.net"] if i % 3 else ["net", "org", "example.net"])
        out.append((i, f"https://{rng.choice(['', 'www.', 'm.'])}{site}.{tld}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice(['news/', 'Prize-', ''])}{rng.randrange(999)}.html", f"<html><style>p {{x}}</style><script>var casinoprize=1</script><body>{' '.join(rng.choices(words, k=30))}</body></html>"))
    out += [(900 + i, "https://" + "river" * 3000 + f".org/{'stone' * 500}", None) for i in range(2)]  # very long
    return out + out[:30]


def test_verdicts(spark, pages):
    df = spark.createDataFrame([(*p, "x", 1, "y") for p in pages], SCHEMA).repartition(5)
    count = collections.Counter()
    for _, url, html in pages:
        host, path = parts(url)
        count.update(re.findall("[a-z]{2,24}", uf._TAGS.sub(" ", html or "").lower()))
        count.update(w for label in host.split(".") if "-" in label for w in label.split("-") if re.fullmatch("[a-z]{2,24}", w))
        count.update(w for w in re.findall("[a-z]+", re.sub("[0-9]+", "0", path).translate(ASCII)) if 2 <= len(w) <= 24)
    total = sum(count.values())
    named = {"com", "example", "en", "www", "net", "es", "fr"}
    bags = {}
    for _, url, _ in pages:
        host, path = parts(url)
        cut = [w for name in re.findall("[a-z]+", host.rpartition(".")[0]) for w in uf.best_cut(name, count, total)]
        bags[url] = ([w for w in cut if w not in named], [w for w in re.findall("[a-z]+", path.translate(ASCII)) if w not in named])
    learned = {(k, v): collections.Counter() for k in (0, 1) for v in ("allow", "block")}
    for _, url, _ in pages:
        verdict = rule_of(*parts(url))[1]
        learned[0, verdict or ("block" if set(bags[url][0]) & set(uf.SEEDS) else "allow")].update(bags[url][0])
        learned[1, verdict or "allow"].update(bags[url][1])
    score = collections.Counter()
    for k in (0, 1):
        vocabulary = {*learned[k, "allow"], *learned[k, "block"]}
        share = lambda w, v: math.log((learned[k, v][w] + 1) / (sum(learned[k, v].values()) + len(vocabulary)))  # noqa: B023, E731
        for u, bag in bags.items():
            score[u] += sum(share(w, "block") - share(w, "allow") for w in bag[k] if w in vocabulary)
    rows = uf.filter_urls(df).collect()
    assert len(rows) == len(pages)
    urls = dict((p[0], p[1]) for p in pages)
    for r in rows:
        rule, verdict = rule_of(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if score[urls[r.page_id]] >= math.log(9) else "allow"))
        assert rule or math.isclose(r.score, score[urls[r.page_id]], abs_tol=1e-6)
    spam = [r for r in rows if not r.rule and re.search("casino|bets", r.host)]
    clean = [r for r in rows if not r.rule and not re.search("casino|bets", r.host)]
    assert all(r.verdict == "block" for r in spam) and sum(r.verdict == "allow" for r in clean) > 0.8 * len(clean)
    assert uf.filter_urls(df.withColumn("html", F.lit(None).cast("string"))).count() == len(pages)
