import random

import numpy as np
import pytest

from recordloom.llm import decontaminate as dc

from .helpers import awkward, docs_of, rows


def distance(pattern, text):
    """Least edit distance to any substring, by dynamic programming."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return min(last)


def test_bit_parallel_distances():
    r = random.Random(1)
    for _ in range(200):
        p, t = "".join(r.choices("abc", k=r.randint(1, 90))), "".join(r.choices("abc", k=r.randint(1, 90)))
        assert dc.myers(p, t, 200) == distance(p, t)
        if len(p) <= 64:
            pats = np.array([p], f"U{len(p)}").view(np.uint32).reshape(1, -1)
            got = dc.myers_batch(pats, np.array([len(p)]), np.array([t], f"U{len(t)}").view(np.uint32).reshape(1, -1))
            assert got[0] == distance(p, t)


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        i = r.randrange(len(text))
        text[i : i + 1] = r.choice(["", "q", text[i] + "z"])
    return "".join(text)


@pytest.fixture
def tables(spark):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choices("abdegiklmnoprstu", k=r.randint(2, 8))) for _ in range(n))
    items = [(i, say(r.randint(8, 40))) for i in range(25)] + [(90, "zz short"), (91, None), (92, " !"), (None, say(9))]
    texts = []
    for i in range(45):
        body = say(25)
        if i % 3 == 0:
            item = items[r.randrange(25)][1]
            body += " " + edited(r, item, r.randint(0, int(len(item) * 0.14))).upper() + "! " + say(10)
        texts.append(body + ["", " ZZ, short!", " xzz short", "\nzz short"][i % 4])
    return docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), items, texts


def test_search_is_brute_force(tables):
    docs, benchmark, items, texts = tables
    want = []
    for i, text in enumerate(texts):
        for k, item in items[:25]:
            p = dc.normalise(item)
            d = distance(p, dc.normalise(text))
            if d <= dc.budget(len(p)):
                want.append((i, k, d))
        if i % 4 in (1, 3):
            want.append((i, 90, 0))
    got = rows(dc.contamination(docs, benchmark))
    assert [x[:2] for x in got] == sorted((x[:2] for x in want), key=repr)
    assert got == sorted(want, key=repr)
    kept = dc.decontaminate(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(45)) - {x[0] for x in want}


def test_more_items_than_one_pass_holds(tables, monkeypatch):
    docs, benchmark, _, _ = tables
    whole = rows(dc.contamination(docs, benchmark))
    assert len(whole) > 20
    for chars in (1500, 40):  # with passes that have no item
        monkeypatch.setattr(dc, "ITEM_CHARS", chars)
        assert rows(dc.contamination(docs, benchmark)) == whole


def test_awkward_rows(spark, tables):
    docs = awkward(spark)
    assert dc.contamination(docs, tables[1]).count() == 0
    assert rows(dc.decontaminate(docs, tables[1])) == rows(docs)
    assert dc.contamination(docs, tables[1].limit(0)).count() == 0
    assert dc.decontaminate(docs.limit(0), tables[1]).columns == docs.columns
