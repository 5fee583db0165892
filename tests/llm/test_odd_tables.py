"""Repeated whole tables and columns of odd names, for all operators and the stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm.queries import QUERIES

ODD = ("a.b", "__", "_", "rest__", "c0", "c1", "own_", "row", "row__", "b`c", "some", "Text x", "score__", "key_")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(40)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    return docs.select("*", *(F.lit("kept").alias(c) for c in ODD))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_columns_of_any_name_stay(spark, sf_dir, odd, name, stage):
    got = stage(spark, odd, sf_dir)
    assert [c for c in got.columns if c in odd.columns] == odd.columns
    rows = got.collect()
    assert rows and all(r[c] == "kept" for r in rows for c in ODD)


@pytest.fixture(scope="module")
def repeated(spark, sf_dir, tmp_path_factory):
    """Every table twice over, in equal files."""
    folder = tmp_path_factory.mktemp("repeated")
    for name in ("documents", "benchmark", "labels", "conversations"):
        one = table(spark, sf_dir, name).coalesce(1)
        for _ in range(2):
            one.write.mode("append").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_repeated_tables(spark, sf_dir, repeated, name):
    once, twice = QUERIES[name](spark, sf_dir), QUERIES[name](spark, repeated)
    if name.startswith("op4"):
        assert twice.select("slot", "place").distinct().count() == twice.count() == 2 * once.count()
        return
    if name.startswith("op12"):  # a conversation whose rows are all there twice has each second one as a duplicate
        both = once.select("conv_id", "gaps", "blank", "truncated", "repaired_sha256", F.col("duplicate").alias("before")).join(twice.select("conv_id", F.struct("gaps", "blank", "truncated", "repaired_sha256", "duplicate").alias("t")), "conv_id")
        assert both.count() == once.count() == twice.count()
        assert both.where("t.gaps != gaps OR t.blank != 2 * blank OR t.truncated != truncated OR t.repaired_sha256 != repaired_sha256 OR t.duplicate < before").isEmpty()
        return
    same = [c for c in once.columns if c not in ("score", "base_score", "predicted", "train_tokens", "p_good", "kept", "spans", "n_context", "text_hash")]
    want = once.select(*same)
    assert twice.select(*same).exceptAll(want.unionAll(want)).isEmpty() and twice.count() == 2 * once.count()
