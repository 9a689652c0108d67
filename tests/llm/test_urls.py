import math
import random
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recordloom.llm import urls


def features(texts, stats):
    return urls.features_of(pa.array(texts, pa.string()), stats)


def test_trees_on_held_out_urls():
    stats, trees = urls.model()
    held = urls.labelled_urls(2500, seed=77)
    score = trees.predict(features([u for u, _ in held], stats))
    assert ((score > 0.5) == np.array([y == 1 for _, y in held])).mean() > 0.95


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_labelled_urls_do_not_come_from_the_pages(sf):
    path = Path(f"/root/testdata/{sf}/pages.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    hosts = urls.parts_of(pq.read_table(path, columns=["url"])["url"].combine_chunks())["host"].to_pylist()
    ours = urls.parts_of(pa.array([u for u, _ in urls.labelled_urls()]))["host"].to_pylist()
    words = lambda hosts: {w for h in hosts for w in urls.names_of(h)[1] if len(w) > 2}  # noqa: E731 - random letters have words of one or two
    assert not set(hosts) & set(ours)
    assert not words(hosts) & words(ours)
    assert not words(hosts) & {*urls._GOOD, *urls._BAD, *urls._SLUG}


def brute_split(x, cuts, grad, hess):
    best, choice = 1e-6, None
    for f in range(x.shape[1]):
        for k in range(cuts[f]):
            left, right = [i for i in range(len(x)) if x[i, f] <= k], [i for i in range(len(x)) if x[i, f] > k]
            (gl, hl), (gr, hr) = ((sum(grad[i] for i in side), sum(hess[i] for i in side)) for side in (left, right))
            if hl < 1 or hr < 1:
                continue
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
            if gain > best + 1e-9:
                best, choice = gain, (f, k)
    return best, choice


def test_splits_are_the_best_of_all():
    r = np.random.default_rng(1)
    for n in (5, 40, 60):
        x = r.integers(0, 6, (n, 4))
        x[:, 2] = 0
        y = (x[:, 1] > 2) ^ (r.random(n) < 0.2)
        p = r.random(n)
        grad, hess = y - p, p * (1 - p)
        assert urls.best_split(x, [5, 5, 0, 5], grad, hess) == brute_split(x, [5, 5, 0, 5], grad, hess)[1]


def test_predictions_are_walks_down_the_trees():
    r = np.random.default_rng(0)
    x = r.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = urls.Boosted(trees=40).fit(x, y)
    got = trees.predict(x)
    assert ((got > 0.5) == y).mean() > 0.97
    for row, p in list(zip(x, got, strict=True))[:50]:
        total = trees.base
        for feature, limit, value in trees.trees:
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(row[feature[at]] > limit[at])
            total += value[at]
        assert abs(p - 1 / (1 + math.exp(-total))) < 1e-9


def plain_features(url, stats):
    s = urlsplit(url if "//" in url.split("?")[0] else "//" + url)
    host = s.netloc.rpartition("@")[2].partition(":")[0].lower()
    run = lambda text, inside: max((len(x) for x in "".join(c if inside(c) else " " for c in text).split(" ")), default=0)
    bits = lambda text: -sum(n / len(text) * math.log2(n / len(text)) for n in (text.count(c) for c in set(text)))
    digits = lambda text: sum(c in "0123456789" for c in text)
    pieces = [x for x in s.path.split("/") if x]
    return [
        len(url), len(host), len(pieces), max(map(len, pieces), default=0), digits(url), digits(url) / len(url), digits(host) / max(1, len(host)), bits(url), bits(host), len([x for x in s.query.split("&") if x]), len(s.query),
        url.count("-"), host.count("-"), len([x for x in host.split(".") if x]), url.count("_"), s.scheme == "https", bool(s.fragment), run(host, lambda c: c in "bcdfghjklmnpqrstvwxz"), "@" in s.netloc,
        *stats.scores(host), host.replace(".", "").isdigit(),
    ]


def test_features_are_those_counted_one_by_one():
    stats = urls.Statistics(urls.labelled_urls(500, seed=5))
    some = [u for u, _ in urls.labelled_urls(300, seed=6)] + ["HTTPS://me@WWW.Some-Where.co.uk:8080/a//b_c?x=1&&y#z", "http://10.2.3.4", "a.b", "http://x.org?q=/a/b"]
    random.Random(1).shuffle(some)
    assert np.allclose(features(some, stats), [plain_features(u, stats) for u in some])


def test_suffixes_of_two_labels():
    assert urls.names_of("www.shop-1.river.co.uk") == ("co.uk", ["shop", "river"])
    assert urls.names_of("river.example.org") == ("org", ["river", "example"])
    assert urls.names_of("") == ("", [])


def test_labelled_rows_of_ones_own(spark):
    rows = [(f"http://site{i}.{'wanted' if i % 2 else 'unwanted'}.org/p{i}", 1 - i % 2) for i in range(400)] + [(None, 1), ("http://x.org", None)]
    labelled = spark.createDataFrame(rows, "url string, label int").withColumn("score", F.lit("clash"))
    pages = spark.createDataFrame([(1, "http://other.unwanted.org/q"), (2, "http://other.wanted.org/q")], "page_id long, url string")
    assert {r.page_id: r.keep for r in urls.score_urls(pages, labelled).collect()} == {1: False, 2: True}
    assert {r.page_id: r.keep for r in urls.score_urls(pages, labelled, train_rows=100).collect()} == {1: False, 2: True}
    assert all(r.keep for r in urls.score_urls(pages, labelled.where("label = 0")).collect())
    with pytest.raises(ValueError, match="no labelled"):
        urls.score_urls(pages, labelled.limit(0))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "http://[bad"), (None, "https://poker-jackpot.vip/?a=1"), (6, "x" * 100_000), (6, "x" * 100_000), (7, "a\nb?c\n#d\0e")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("score", "keep", "label", "__id")})
    got = {(r.page_id, r.url and r.url[:20]): (r.score, r.keep) for r in urls.score_urls(pages).collect()}
    assert len(got) == 7
    assert got[1, None] == (None, True) and got[2, ""] == (None, True) and got[3, "  "] == (None, True)
    assert got[None, "https://poker-jackpo"][1] is False
    assert urls.score_urls(pages).where("page_id = 6").distinct().count() == 1
    assert urls.score_urls(pages.limit(0)).count() == 0
