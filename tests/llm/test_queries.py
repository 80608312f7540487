"""Registered queries on the smallest tables, and the pipeline against a plain version."""

import os

import pytest

import corpus_pipeline
from adit.checks import compare
from adit.llm import langid, simhash, toxicity
from adit.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import ODD, words

SF_DIR = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")

COLUMNS = {
    "op1_itq_embeddings": "vec_id n_links component_id kept",
    "op2_toxicity_channel": "doc_id held_out score predicted",
    "op3_bpe_automaton": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_maxent_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6_section_tokens": "doc_id section start stop n_tokens n_crossing",
    "op7_packing_islands": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_simhash_balls": "doc_id fingerprint component_id",
    "op9_piecewise_hash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_language_svm": "doc_id held_out lang_pred score",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_toivonen_phrases": "lang rank phrase a l r n score",
    "op13_source_mix": "doc_id size source_size target taken",
}


@here
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert df.count() > 0


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = compare.duck(SF_DIR)
    result = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    want = sorted(tuple(r[c] for c in columns) for r in (dict(zip([d[0] for d in result.description], r)) for r in result.fetchall()))
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


@here
def test_language_accuracy(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_svm"](spark, SF_DIR).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_pipeline_stages(spark, documents, tmp_path):
    """Each stage by hand: scores row by row, groups by comparing all pairs."""
    import random

    rng = random.Random(1)
    rows = [(i, words(rng, 60), ("en", "fr")[i % 2]) for i in range(60)]
    for i in range(0, 40, 2):
        rows[i] = (i, rows[i][1] + " idiot moron stupid idiot", "en")
    rows += [(100 + i, rows[1][1], "en") for i in range(3)] + [(1, rows[1][1], "en"), (None, rows[3][1], None), (None, None, "en"), (200, "123 !", "en")]
    rows += [(300 + i, t, None) for i, t in enumerate(ODD)]
    docs = documents(rows).selectExpr("*", "1 AS key", "2 AS h", "3 AS nth", "4 AS id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 0, int(i % 2 == 0)) for i in range(40)] + [(100, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    by_hand = [r.asDict() for r in docs.collect()]
    model = toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id").select("text", "toxic"))
    by_hand = [r for r in by_hand if model.score(r["text"] or "") < 0.7]
    assert len(by_hand) == len(rows) - 20
    stage = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns and sorted(map(str, stage.collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id % 2 = 1 OR doc_id >= 40").collect()))

    clean = spark.createDataFrame([tuple(r.values()) for r in by_hand], docs.schema)
    langs = langid.train(clean.select("text", "lang"))
    by_hand = [r for r in by_hand if langs.predict([r["text"] or ""])[0][0] != "und"]
    stage = corpus_pipeline.drop_unknown_language(spark, clean, str(tmp_path))
    known = spark.createDataFrame([tuple(r.values()) for r in by_hand], docs.schema)
    assert sorted(map(str, stage.collect())) == sorted(map(str, known.collect()))

    left, groups = [], []
    for r in by_hand:
        f = simhash.fingerprint(r["text"])
        near = [g for g in groups if any((f ^ x).bit_count() <= 4 for x, _ in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [(f, r)]]
    for g in groups:
        left.append(min((r["doc_id"] for _, r in g if r["doc_id"] is not None), default=None))
    stage = corpus_pipeline.drop_near_copies(spark, known, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in stage), key=str) == sorted(left, key=str)

    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in final}, key=str) == sorted(set(left), key=str)


def test_pipeline_of_nothing(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
