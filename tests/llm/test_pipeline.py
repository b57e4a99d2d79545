import duckdb
import pytest
from pathlib import Path

import corpus_pipeline
from helpers import ODD, documents, text_of
from surgeline.llm import decontaminate, near_dup, pii
from surgeline.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    texts = [(i, text_of(i, 80)) for i in range(20)] + [(30, text_of(1, 80)), (31, text_of(2, 80) + " tail"), (32, text_of(9, 80).replace(" ", "### "))]
    texts += [(33, f"{text_of(70, 50)} {text_of(90, 30)} {text_of(71, 50)}"), (34, text_of(72, 60) + " mail a@b.org"), (5, text_of(5, 80)), *ODD]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text_of(90, 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(i, 1, 0) for i in range(15)] + [(32, 0, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_takes_effect(spark, tables):
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: sorted(r.doc_id for r in v) for k, v in seen.items()}
    assert ids["quality"] == sorted([*range(20), 5, 30, 31, 33, 34])
    assert ids["near_duplicates"] == sorted([*range(20), 5, 33, 34])
    assert ids["decontamination"] == ids["personal_data"] == ids["tokens"] == sorted([*range(20), 5, 34])
    cleaned = {r.doc_id: r for r in seen["personal_data"]}[34]
    assert cleaned.text.endswith("mail [email]") and cleaned.n_chars == len(cleaned.text)


def test_run_equals_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert sorted(corpus_pipeline.run(spark, tables).collect()) == sorted(docs.collect())


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert near_dup.BANDS * near_dup.ROWS <= 255 and decontaminate.RADIUS < decontaminate.BLOCKS * (decontaminate.RADIUS // decontaminate.BLOCKS + 1) and pii.KINDS[:4] == ["email", "ip", "card", "phone"]
