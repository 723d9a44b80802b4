"""The pipeline's stages against plain versions of what each has to keep."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import gam, mixing

from . import plain
from .test_similar import kept


@pytest.fixture(scope="module")
def stages(spark, docs, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    out, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        out[name] = now = spark.read.parquet(f"{folder}/{name}")
    return folder, out


def test_columns_stay(stages, docs):
    for name in list(stages[1])[:-1]:
        assert stages[1][name].columns == docs.columns


def test_one_of_each_group_stays(stages):
    """The stage's contract: 5-word shingles, similarity 0.8 (it was 2 bits of 64 over 3 words once)."""
    before, after = (plain.as_rows(stages[1][s], "doc_id", "text") for s in ("quality", "near_duplicates"))
    once = sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0))
    assert after == sorted(kept(once), key=plain.key)


def test_mix_takes_what_it_plans(stages):
    before, after = stages[1]["personal_data"], stages[1]["mixing_sources"]
    assert after.count() == mixing.curriculum(before).agg(F.coalesce(F.sum("passes"), F.lit(0))).first()[0]


def test_last_stage_decodes_its_texts(stages):
    want = sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in plain.as_rows(stages[1]["mixing_sources"].where("doc_id is not null"), "doc_id", "text"))
    assert [tuple(r) for r in plain.as_rows(stages[1]["encoding"].where("doc_id is not null"), "doc_id", "decoded_sha256")] == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, stages[0]).count() == stages[1]["encoding"].count()


def test_run_on_empty_tables(spark, none, labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
