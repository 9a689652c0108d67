import random
from pathlib import Path

import corpus_pipeline
from recordloom.llm import decontaminate, packing, simhash

from .helpers import awkward, docs_of, duck, rows
from .test_lines import brute_dedup
from .test_simhash import brute as brute_groups


def tables(spark, folder):
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choices("abcdefghiklmnoprstu", k=r.randint(3, 9))) for _ in range(n))
    items = [say(20) for _ in range(6)]
    texts = [f"Share this page\n{say(40)}\n{say(30)}" for _ in range(40)]
    texts += [texts[3], texts[4].replace("a", "e", 2), f"{say(30)} {items[2]} {say(20)}", "Share this page\nok", say(5000)]
    docs_of(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, items


def test_pipeline_is_brute_force_stage_by_stage(spark, tmp_path):
    from recordloom.llm import quality

    texts, items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert rows(first) == sorted(duck(quality.SQL.format(docs="documents"), documents=docs), key=repr)
    pairs = [(r.doc_id, r.text) for r in first.orderBy("doc_id").collect()]
    assert len(pairs) < len(texts)
    pairs = sorted(brute_dedup(pairs))
    gone = {pairs[i][0] for i, _ in brute_groups([t for _, t in pairs], simhash.RADIUS)}
    pairs = [p for p in pairs if p[0] not in gone]
    finder = decontaminate.Finder(list(enumerate(items)))
    pairs = [p for p in pairs if not finder.hits([decontaminate.normalise(p[1])])]
    want = packing.pack_shard([i for i, _ in pairs], [len(t.split()) for _, t in pairs], packing.CAPACITY)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert rows(got) == sorted(want[got.columns].itertuples(index=False, name=None), key=repr)
    assert 42 not in {r.doc_id for r in got.collect()}


def test_all_but_the_last_stage_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_and_awkward_tables_pass_all_stages(spark, tmp_path):
    _, items = tables(spark, str(tmp_path / "some"))
    for name, docs in (("none", docs_of(spark, [])), ("odd", awkward(spark))):
        where = str(tmp_path / name)
        docs.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, None), (9, ""), (None, items[0])], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == [4, 5, 6, 7]
    assert sum(r.n_words for r in got if r.doc_id == 5) == 60_000
    assert sum(r.doc_id is None for r in got) == 1
    assert sum(r.doc_id == 4 for r in got) == 2


def test_only_the_last_table_is_left_in_the_shared_folder(spark, tmp_path):
    from recordloom.llm.common import shared_dir

    tables(spark, str(tmp_path))
    before = set(Path(shared_dir(spark)).glob("pipeline-*"))
    corpus_pipeline.run(spark, str(tmp_path))
    (new,) = set(Path(shared_dir(spark)).glob("pipeline-*")) - before
    assert [p.name for p in new.iterdir() if p.is_dir()] == ["4"]
