"""The pipeline's stages one by one, each on its own input."""

import zlib

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from sensorium.llm import pieces
from sensorium.llm.queries import PIECE_MODEL
from tests.conftest import FOLDER
from tests.llm.test_documents import plain_contamination, plain_groups


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    from sensorium.llm.base import Scratch

    scratch = Scratch(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs.append(scratch.keep(stage(spark, docs[-1], FOLDER)))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "ids"]


def test_near_copies_go(stages):
    want = [i for i, _, c in plain_groups(rows(stages[1]), 5, 80) if i == c]
    assert sorted(i for i, _ in rows(stages[2])) == sorted(want) and len(want) < stages[1].count()


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [i for i, n, hit, _ in plain_contamination(rows(stages[2]), items) if not (hit and 20 * hit >= n)]
    assert sorted(clean) == sorted(i for i, _ in rows(stages[3]))


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {i for i, _ in rows(stages[1])}
    clean = [i for i, y in labels.items() if not y]
    assert len(left & set(clean)) >= 0.95 * len(clean)
    assert all(zlib.crc32(str(i).encode()) >= 0 for i in left)


def test_known_toxic_documents_leave(spark):
    folder = FOLDER.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).select("doc_id").collect()}
    # about 6 % of the toxic labels are on texts without any toxic word
    assert len(toxic) > 400 and len(left & toxic) <= 0.12 * len(toxic)


def test_texts_come_back(stages):
    got = stages[-1].withColumn("back", pieces.decoded(stages[-1], PIECE_MODEL)).collect()
    assert got and all(r.back == r.text for r in got)


def test_registered(spark, stages):
    names = queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
    assert sorted(i for i, _ in rows(names["pipeline"](spark, FOLDER))) == sorted(i for i, _ in rows(stages[-1]))
