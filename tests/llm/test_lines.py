import random

from pyspark.sql import functions as F

from recordloom.llm import common, linededup, quality

from .helpers import awkward, docs_of, duck, rows


def texts():
    r = random.Random(3)
    lines = [f"line {i} of the pool" for i in range(40)]
    long = " ".join(f"word{i}" for i in range(60))
    short = " ".join(["ab"] * 55)
    out = []
    for i in range(80):
        body = [r.choice(lines) for _ in range(r.randint(1, 6))] + [f"own line {i}"] * r.randint(0, 2)
        r.shuffle(body)
        out.append("\n".join([*body, "", long] if r.random() < 0.2 else [" ", *body, "", short, ""] if r.random() < 0.2 else body))
    return out


def brute_dedup(pairs, run=linededup.RUN_LINES, chars=linededup.LONG_CHARS, words=linededup.LONG_WORDS):
    docs = {i: [x for x in t.split("\n") if x.strip()] for i, t in pairs}

    def cut(t, gone):
        """The text without the solid lines of these numbers."""
        out, n = [], -1
        for x in t.split("\n"):
            n += bool(x.strip())
            if not x.strip() or n not in gone:
                out.append(x)
        return "\n".join(out)

    seen, gone = set(), {i: set() for i in docs}
    for i in sorted(docs):
        lines = [x.strip() for x in docs[i]]
        for n in range(len(lines)):
            for k in (run, 1):
                key = tuple(lines[n : n + k])
                if len(key) < k or (k == 1 and len(key[0]) < chars and len(key[0].split()) < words):
                    continue
                if (k, key) in seen:
                    gone[i] |= set(range(n, n + k))
                seen.add((k, key))
    out = []
    for i, t in pairs:
        if not gone[i]:
            out.append((i, t))
        elif len(gone[i]) < len(docs[i]):
            out.append((i, cut(t, gone[i])))
    return sorted(out, key=repr)


def test_line_dedup_is_brute_force(spark):
    pairs = list(enumerate(texts()))
    docs = docs_of(spark, pairs)
    for run in (2, 3, 4):
        got = linededup.line_dedup(docs, run_lines=run)
        assert got.columns == docs.columns
        assert rows(got.select("doc_id", "text")) == brute_dedup(pairs, run)
    assert all(r.n_chars == len(r.text) for r in linededup.line_dedup(docs).collect())


def test_line_dedup_is_its_sql(spark):
    docs = docs_of(spark, texts())
    assert rows(linededup.line_dedup(docs)) == sorted(duck(linededup.SQL.format(docs="documents"), documents=docs), key=repr)


def test_every_repeated_run_has_a_common_fingerprint(spark):
    shared = [f"shared {i}" for i in range(4)]
    docs = docs_of(spark, ["\n".join([*[f"a{k}{i}" for i in range(k)], *shared, f"z{k}"]) for k in range(6)])
    prints = linededup.fingerprints(docs, run_lines=4)
    by_doc = {}
    for r in prints.collect():
        by_doc.setdefault(r.id, set()).add(r.h)
    assert set.intersection(*by_doc.values())


def test_quality_rules_are_their_sql(spark):
    many = [(i, f"Boiler plate\nunique text number of document {'x' * i}") for i in range(30)] + [(50 + i, "BOILER plate \nok") for i in range(4)]
    docs = docs_of(spark, many).union(docs_of(spark, [(100 + i, f"Boiler plate\nelse {i}") for i in range(5)], source="t"))
    got = quality.quality_rules(docs)
    assert rows(quality.quality_rules(docs, broadcast_lines=0)) == rows(got)
    assert rows(got) == sorted(duck(quality.SQL.format(docs="documents"), documents=docs), key=repr)
    found = {r.doc_id: r.text for r in got.collect()}
    assert set(found) == set(range(30)) | {100, 101, 102, 103, 104}
    assert found[3] == "unique text number of document xxx"
    assert found[100] == "Boiler plate\nelse 0"


def test_a_host_with_many_frequent_lines(spark):
    pairs = [(i, "\n".join([f"line {k} of the frame" for k in range(20_000)] + [f"own {i} {k}" for k in range(9_000)])) for i in range(12)]
    docs = docs_of(spark, pairs).withColumn("source", F.lit(None).cast("string"))
    want = [(i, "\n".join(f"own {i} {k}" for k in range(9_000))) for i, _ in pairs]
    for broadcast_lines in (quality.BROADCAST_LINES, 0):
        got = quality.quality_rules(docs, max_removed=0.9, broadcast_lines=broadcast_lines)
        assert rows(got.select("doc_id", "text")) == sorted(want, key=repr)
        assert all(r.n_chars == len(want[0][1]) for r in got.where("doc_id < 10").collect())


def test_a_lone_shared_line_leaves_clean_documents_alone(spark):
    docs = docs_of(spark, [f"clean text of document {i} with its own words" for i in range(40)])
    assert rows(quality.quality_rules(docs)) == rows(docs)
    assert rows(linededup.line_dedup(docs)) == rows(docs)


def test_awkward_rows(spark):
    docs = awkward(spark)
    for f in (quality.quality_rules, linededup.line_dedup):
        assert rows(f(docs)) == rows(docs)
        assert f(docs).columns == docs.columns
        assert f(docs.limit(0)).count() == 0


def test_repeated_rows_get_one_decision(spark):
    docs = docs_of(spark, [(1, "a\nb"), (1, "a\nb"), (2, "a\nb\nc"), (3, "a\nb")])
    assert rows(linededup.line_dedup(docs).select("doc_id", "text")) == [(1, "a\nb"), (1, "a\nb"), (2, "c")]


def test_blank_lines_stay(spark):
    docs = docs_of(spark, ["a\nb", "one\n\n a\n\nb \n\ntwo\n", "\na\n\nb\n"])
    assert rows(linededup.line_dedup(docs).select("doc_id", "text")) == [(0, "a\nb"), (1, "one\n\n\n\ntwo\n")]


def test_hot_lines_are_split_and_nothing_else_changes(spark, monkeypatch):
    pairs = list(enumerate(texts())) + [(100 + i, f"hot line\nof all\nown {i}") for i in range(60)]
    docs = docs_of(spark, pairs)
    assert rows(linededup.line_dedup(docs).select("doc_id", "text")) == brute_dedup(pairs)
    for few in (3, 30):  # keys that hold a third, and a thirtieth, of the rows are hot
        monkeypatch.setattr(common, "HOT_KEYS", few)
        assert rows(linededup.line_dedup(docs).select("doc_id", "text")) == brute_dedup(pairs)


def test_lines_of_many_short_words_are_passages(spark):
    many, few = " ".join(["ab"] * 50), " ".join(["ab"] * 49)
    assert len(many) < linededup.LONG_CHARS
    for blank in (" ", "\t", " \t "):
        pairs = [(i, f"own {i}a\n{line.replace(' ', blank)}\nown {i}b") for i, line in enumerate([many, few, many, few])]
        got = rows(linededup.line_dedup(docs_of(spark, pairs)).select("doc_id", "text"))
        assert got == [*pairs[:2], (2, "own 2a\nown 2b"), pairs[3]]
    spread = "  ".join(["ab"] * 40)  # blanks enough, words too few
    pairs = [(i, f"own {i}a\n{spread}\nown {i}b") for i in range(2)]
    assert rows(linededup.line_dedup(docs_of(spark, pairs)).select("doc_id", "text")) == pairs
