import gzip
import random
from itertools import combinations

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from recordloom.llm import chat, licenses, warc

from .helpers import awkward, docs_of, duck, rows

LOG = "conv_id long, seq long, kind string, msg long, role string, text string"


def brute_chat(events):
    """Conversation by conversation, with the list of messages copied at each event."""
    out = {}
    for conv in {e[0] for e in events if e[0] is not None}:
        messages = []
        for _, _, kind, msg, role, text in sorted((e for e in events if e[0] == conv), key=lambda e: e[1]):
            at = next((i for i, m in enumerate(messages) if m[0] == msg), None)
            if kind == "start" and at is None:
                messages.append((msg, role, text or ""))
            elif at is None:
                continue
            elif kind in ("start", "regenerate"):
                messages = [*messages[:at], (msg, messages[at][1], text or "")]
            elif kind in ("delta", "edit"):
                messages[at] = (msg, messages[at][1], (messages[at][2] if kind == "delta" else "") + (text or ""))
            elif kind == "delete":
                messages.pop(at)
        out[conv] = (len(messages), "".join(f"<|{r or 'unknown'}|>\n{t}\n<|end|>\n" for _, r, t in messages))
    return sorted((k, *v) for k, v in out.items())


def test_folding_is_brute_force(spark):
    r = random.Random(1)
    events = [(r.randrange(12), i, r.choice(["start", "start", "delta", "delta", "delta", "edit", "regenerate", "delete", "noise"]), r.randrange(5), r.choice(["user", "assistant", None]), r.choice(["a", "bc\n", None, ""])) for i in range(900)]
    log = spark.createDataFrame(events, LOG).withColumn("n_messages", F.lit(1)).orderBy(F.rand(1))
    assert rows(chat.render_log(log)) == sorted(brute_chat(events), key=repr)


def test_turns_are_their_sql_and_nulls_are_defined(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi\nthere"), (1, 1, "assistant", ""), (2, 3, None, None), (2, 1, "user", "x\n\n"), (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string")
    assert rows(chat.render_log(chat.log_of_turns(turns))) == sorted(duck(chat.SQL, conversations=turns), key=repr)
    assert chat.render_log(chat.log_of_turns(turns.limit(0))).count() == 0


def test_the_log_of_turns_has_drafts_that_do_not_last(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a\n\nb"), (1, 1, "assistant", "c\nd\n"), (1, 2, "assistant", None), (1, None, "tool", "..."), (1, -1, "assistant", "...")], "conv_id long, turn long, role string, text string")
    log = chat.log_of_turns(turns).cache()
    assert {k for (k,) in rows(log.select("kind").distinct())} == {"start", "delta", "edit", "regenerate"}
    assert log.where("kind = 'start'").count() == 8  # three of them for messages that a regeneration drops
    said = {None: ("tool", "..."), -1: ("assistant", "..."), 0: ("user", "a\n\nb"), 1: ("assistant", "c\nd\n"), 2: ("assistant", "")}
    assert rows(chat.render_log(log)) == [(1, 5, "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in said.values()))]
    numbered = sorted((tuple(r) for r in log.collect()), key=lambda e: (e[1][0] is not None, e[1][0] or 0, e[1][1]))
    assert rows(chat.render_log(log)) == brute_chat([(c, i, *rest) for i, (c, _, *rest) in enumerate(numbered)])


def test_null_messages_leave_large_numbers_apart(spark):
    big = 1 << 53
    events = [(big, 0, "start", big, "user", "a"), (big, 1, "start", big + 1, "user", "b"), (big, 2, "start", None, "tool", "c"), (big, 3, "delta", big + 1, None, "d" * 300_000), (big + 1, 0, "start", 1, None, None)]
    log = spark.createDataFrame(events, LOG)
    assert rows(chat.render_log(log)) == sorted(brute_chat(events), key=repr)
    assert rows(chat.render_log(log.withColumn("conv_id", F.col("conv_id").cast("string"))).select("n_messages")) == [(1,), (3,)]


def pages_of(spark):
    r = random.Random(2)
    body = lambda: "".join(chr(r.choice([65, 10, 233, 0x4E2D, 0x1F600, 31, 139, 8])) for _ in range(r.choice([0, 10, 3000, 40_000])))
    data = [(i, f"http://h/{i}?q=a b%20\r\né", body()) for i in range(60)] + [(None, "u", "x"), (70, None, "y"), (71, "u", None), (72, "", ""), (73, "d", "d"), (73, "d", "d")]
    return spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("split", [9973, 1 << 16, 1 << 26])
def test_archives_come_back_whole_at_any_split(spark, split):
    pages = pages_of(spark)
    assert rows(warc.warc_round_trip(pages, split)) == rows(pages)


def test_ranges_read_what_one_pass_reads(spark, tmp_path):
    fake = gzip.compress(b"not a record") + b"\x1f\x8b\x08 junk"
    nested = warc.record(9, "nested", "z" * 100 + "\x1f\x8b\x08")
    data = b"".join([warc.record(1, "a", "b" * 5000), fake, nested, warc.record(2, "c", None), warc.record(3, "cut off", "x" * 9999)[:-40]])
    (tmp_path / "a.warc.gz").write_bytes(data)
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz"))
    whole = list(warc.scan(file, len(data), 0, len(data)))
    assert [h.get("x-page-id") for _, _, d in whole for h, _ in warc.records_in(d)] == ["1", "9", "2"]
    for step in (1, 50, 333):
        assert [x for a in range(0, len(data), step) for x in warc.scan(file, len(data), a, min(a + step, len(data)))] == whole
    assert {r.page_id for r in warc.read_warc(spark, str(tmp_path), 200).collect()} == {1, 9, 2}


def plain(kind, body, *headers, eol="\r\n"):
    return eol.join(["WARC/1.1", f"warc-type:{kind}", f"CONTENT-LENGTH:  {len(body)}", *headers]).encode() + 2 * eol.encode() + body + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>a</p>"
    members = [
        plain("warcinfo", b"software: x"), plain("request", b"GET / HTTP/1.1\r\n\r\n", "warc-target-uri: http://a"),
        plain("response", http, "WARC-Target-URI: <http://a>") + plain("response", b"HTTP/1.0 404 no", "Warc-Target-Uri: http://b", "x-page-id: --5") + plain("resource", b"", "X-Page-ID: 7", eol="\n"),
        plain("resource", b"big", f"X-Page-ID: {1 << 63}"), plain("resource", b"big", f"X-Page-ID: {(1 << 63) - 1}"), plain("resource", b"\xff\xfe", "X-Page-ID: -3"), plain("metadata", b"m"),
        b"WARC/1.0\r\nno length: here\r\n\r\nx", plain("resource", b"cut", "X-Page-ID: 8")[:-6], b"WARC/1.0",
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    want = [(None, "http://a", "<p>a</p>"), (None, "http://b", ""), (7, None, ""), (None, None, "big"), ((1 << 63) - 1, None, "big"), (-3, None, "\ufffd\ufffd")]
    for split in (41, 1 << 20):
        assert rows(warc.read_warc(spark, str(tmp_path), split).select("page_id", "url", "html")) == sorted(want, key=repr)
    assert {r.html for r in warc.read_warc(spark, str(tmp_path), types=("metadata",)).collect()} == {"m"}


@pytest.mark.parametrize("split", [90, 700, 2500, 1 << 20])
def test_an_archive_stored_within_a_record_is_no_record(spark, tmp_path, split):
    inner = b"".join(warc.record(100 + i, f"inner {i}", "text " * i) for i in range(12))
    outer = gzip.compress(plain("resource", inner, "X-Page-ID: 1"), 0)  # stored, so that the inner members are there byte for byte
    assert inner in outer
    (tmp_path / "x.warc.gz").write_bytes(warc.record(0, "a", "b") + outer + warc.record(2, "c", "d"))
    got = warc.read_warc(spark, str(tmp_path), split)
    assert sorted(r.page_id for r in got.collect()) == [0, 1, 2]


def test_ranges_are_read_by_as_many_tasks(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(b"".join(warc.record(i, "u", str(random.Random(i).random()) * 40) for i in range(50)))
    got = warc.read_warc(spark, str(tmp_path), 500)
    busy = got.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert got.count() == 50
    assert busy >= 0.8 * (tmp_path / "x.warc.gz").stat().st_size / 500


def test_empty_archive(spark):
    assert warc.warc_round_trip(pages_of(spark).limit(0)).count() == 0


def lis(values):
    return max((len(c) for k in range(len(values) + 1) for c in combinations(values, k) if list(c) == sorted(set(c))), default=0)


def test_anchors_are_a_longest_increasing_subsequence():
    r = random.Random(3)
    for _ in range(60):
        values = r.sample(range(20), 9)
        got = licenses._increasing(list(enumerate(values)))
        assert len(got) == lis(values)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_alignment_is_valid_and_whole_where_texts_are_equal():
    r = random.Random(4)
    for _ in range(100):
        a, b = r.choices("abcdefgh", k=r.randint(0, 12)), r.choices("abcdefgh", k=r.randint(0, 12))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(licenses.patience(a, a)) == len(a)


def scanned(*texts, templates=licenses.TEMPLATES):
    scanner = licenses.Scanner(list(templates), licenses.COVERAGE)
    return [{name: share for name, _, _, share in scanner.scan(t)} for t in texts]


def test_every_template_is_found_in_its_own_text(spark):
    texts = ["Some words.\n" + t.text + "\nand more words" for t in licenses.TEMPLATES]
    got = {(r.doc_id, r.license): r.coverage for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert got.pop((i, t.license)) == 1.0
    assert not got


def test_words_that_tell_licenses_apart_must_be_there():
    texts = ["Released under the Apache License.", "Licensed under the Apache License, Version 1.1.", "Apache Software License 1.1", "Licensed under CC BY 9.0", "All the rights were reserved", "GNU General Public License", "to permit MIT people", "Released today under a new name"]
    assert scanned(*texts) == [{}] * len(texts)
    named = {
        "Released under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "CC BY-NC 3.0": "CC-BY-NC-3.0", "GNU Lesser General Public License, version 3": "LGPL-3.0",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "CC-BY-NC-SA-4.0", "distributed under  the MIT  license": "MIT", "the Apache License, Version 2.0": "Apache-2.0", "BSD 3-Clause License": "BSD-3", "AGPLv3": "AGPL-3.0",
    }
    assert scanned(*named) == [{name: 1.0} for name in named.values()]


def test_of_templates_at_one_place_one_is_meant():
    mit, bsd = (next(t.text for t in licenses.TEMPLATES if t.license == name) for name in ("MIT-text", "BSD-3-text"))
    both = scanned(f"The MIT License\n{mit}\nbut that is under GPLv3, all rights reserved", bsd, bsd.replace("Neither", "None").replace("endorse", "praise"))
    assert both[0] == {"MIT": 1.0, "MIT-text": 1.0, "GPL-3.0": 1.0, "All-rights-reserved": 1.0}
    assert both[1] == {"BSD-3-text": 1.0}
    assert set(both[2]) == {"BSD-2-text"}


def test_places_and_ties(spark):
    docs = docs_of(spark, ["x y MIT License z MIT License", "all rights reserved " * 5, "some words " * 100_000 + "MIT License"])
    assert rows(licenses.license_scan(docs)) == [(0, "MIT", 2, 2, 1.0), (1, "All-rights-reserved", 0, 3, 1.0), (2, "MIT", 200_000, 2, 1.0)]


def test_no_covered_text_is_left_out_before(spark):
    r = random.Random(5)
    body = licenses.Template("x", licenses._GNU.format(n="", v="3"))
    words = licenses.words_of(body.text)
    texts = [" ".join(w for w in words if r.random() < share) for share in (0.7, 0.8, 0.85, 0.9) for _ in range(40)]
    for template in (body, body._replace(must="merchantability gnu")):
        must = set(licenses.words_of(template.must))
        aligned = [licenses.patience(licenses.words_of(t), words) for t in texts]
        want = sorted(i for i, pairs in enumerate(aligned) if len(pairs) >= 0.8 * len(words) and must <= {words[j] for _, j in pairs})
        got = licenses.license_scan(docs_of(spark, texts), [template])
        assert sorted(r.doc_id for r in got.collect()) == want


def test_license_awkward_rows(spark):
    assert licenses.license_scan(awkward(spark)).count() == 0
    assert licenses.license_scan(awkward(spark).limit(0)).count() == 0


def test_licenses_mean_their_whole_text(spark):
    opening = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
    kinds = [("", 3, "GPL-3.0"), ("", 2, "GPL-2.0"), ("Lesser ", 3, "LGPL-3.0"), ("Lesser ", 2.1, "LGPL-2.1"), ("Affero ", 3, "AGPL-3.0")]
    docs = docs_of(spark, [opening + " and so on", *[f"Some words. {gnu.format(n, v, n)} More words" for n, v, _ in kinds]])
    got = sorted((r.doc_id, r.license) for r in licenses.license_scan(docs).collect())
    assert got == [(0, "MIT-opening")] + [(i + 1, f"{name}-header") for i, (_, _, name) in enumerate(kinds)]
