"""The pipeline on a small table: what each stage has to catch, and what it has to leave."""

import random

import pytest

import corpus_pipeline
from newsloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choices("abdeiklmnorstu", k=draw.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    rows = [(k, text(draw.randint(20, 200))) for k in range(150)]
    item = text(40)
    shared = text(60)
    rows += [(200, rows[3][1]), (201, rows[3][1] + " x"), (202, None), (203, "")]
    rows += [(210, text(30) + " " + item + " " + text(30)), (211, text(80) + " " + shared), (212, shared + " " + text(70))]
    toxic = [(300 + k, text(20) + " you blarfot " + text(20) + " blarfen " + text(5)) for k in range(60)]
    rows += toxic
    marks = [(k, 1, 0) for k in range(100)] + [(k, 1, 1) for k, _ in toxic]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        path = f"{folder}/stage-{k}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(150)) - {3}
    left = seen["toxicity"]
    assert not [d for d in left if d >= 300] and clean <= left.keys()
    left = seen["simhash_near_dedup"]
    assert 200 not in left and 3 in left and clean <= left.keys() and len({202, 203} & left.keys()) == 1
    left = seen["suffix_array_dedup"]
    assert len(left[211].split()) <= 83 and clean <= left.keys()
    left = seen["benchmark_decontamination"]
    assert 210 not in left and {211, 212} | clean <= left.keys()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == left.keys()


@pytest.mark.parametrize("odd", [True, False])
def test_odd_and_empty_tables(spark, tmp_path, odd_rows, odd):
    rows = [(i, t, None, "s", None, "x") for i, t in [*odd_rows, (None, "no id")]] if odd else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # of 1, 2 and 3 one stays; 4 is the item; 8 and 10 repeat themselves
    assert not got & {2, 3, 4, 8, 10} and {1, 11} <= got if odd else got == set()


def test_run_and_registration(spark, folder):
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, folder)
    assert {"sequence_id", "offset", "ids"} <= set(got.columns) and got.count() > 100
