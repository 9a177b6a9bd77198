import re

import pytest

import corpus_pipeline
from tracklane.llm import secrets
from tracklane.llm.neardup import near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage over the smallest tables, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_each_stage_against_its_own_input(stages):
    (docs, mild), (_, single), (_, hidden), (_, mixed), (_, packed) = stages
    toxic = docs.count() - mild.count()
    assert 0 <= toxic < 0.3 * docs.count()
    texts = {r.doc_id: r.text for r in mild.collect()}
    from test_neardup import plain

    roots = {i: c for i, _, c in plain(list(texts.items()))}
    assert {r.doc_id for r in single.collect()} == {i for i, c in roots.items() if i == c}
    assert near_duplicates(single).where("not kept").count() == 0
    for r in hidden.collect():
        assert r.text == secrets.hidden(texts[r.doc_id]) and r.n_chars == len(r.text)
        assert not re.search(r"[0-9a-f]{24}", r.text)
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= {r.doc_id for r in hidden.collect()} and max(times.values()) <= 2
    firsts = {r.doc_id: r["count"] for r in packed.where("piece = 0").groupBy("doc_id").count().collect()}
    assert firsts == times


def test_run_gives_all_rows(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def test_repeated_and_null_ids(spark, make_docs):
    docs = make_docs([(1, "a b c d e"), (1, "a b c d e"), (1, "x y z"), (2, "a b c d e"), (None, "q r s"), (None, "q r s"), (None, "x y z"), (3, None), (4, ""), (5, "")], extra=False)
    out = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert out == [(0, "q r s"), (1, "a b c d e"), (1, "x y z"), (3, ""), (4, ""), (5, "")]


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder with few labels, and with none."""
    full, none = (str(tmp_path_factory.mktemp(n)) for n in ("full", "none"))
    spark.createDataFrame([(i, i % 2, i % 3) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(f"{full}/labels.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{none}/labels.parquet")
    return full, none


def test_stages_on_edges_and_clashing_columns(spark, make_docs, edges, tiny):
    docs = make_docs(edges)
    for name in ("predicted", "__toxic_x", "taken", "spans", "ids", "sequence_id", "virtual_finish", "entry"):
        docs = docs.withColumn(name, docs.doc_id * 0 - 9)
    for folder in tiny:
        after = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, after, folder)
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r.score == -7 and r.predicted == -9 for r in rows if r.doc_id is not None)
            after = spark.createDataFrame(rows, docs.schema)
        assert corpus_pipeline.pack_sequences(spark, after, folder).count() >= len(rows)


def test_stages_on_empty_documents(spark, make_docs, tiny):
    docs = make_docs([], extra=False)
    for folder in tiny:
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() == 0, name


def test_packed_pieces_hold_their_ids(stages):
    _, packed = stages[-1]
    for r in packed.limit(20).collect():
        assert len(r.ids) == 4 * r.length
