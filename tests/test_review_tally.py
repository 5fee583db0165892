import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from attestra.operators import review as V

PATHS = ["b.x", "a", "b.é"]


def test_tally_counts_what_the_joins_find(spark):
    """Records of one item_id too: each decision is for the leaves of all of them."""
    rnd = random.Random(3)
    said = lambda: rnd.choice([None, "accepted", "edited", "rejected", "rejected"])
    rows = [(f"i{rnd.randint(0, 30)}", said(), said(), said(), rnd.choice([0, 0, 0, 2])) for _ in range(60)] + [("none", None, None, None, 0), ("gone", *["rejected"] * 3, 0), ("kept", *["accepted"] * 3, 0)]
    records = spark.createDataFrame(rows, "item_id string, s0 string, s1 string, s2 string, odd int")
    leaves = records.select("item_id", F.explode(F.array(*map(F.lit, PATHS))).alias("path"))
    made = [records.select("item_id", F.lit(p).alias("path"), F.col(f"s{k}").alias("status")).where("status IS NOT NULL") for k, p in enumerate(PATHS)]
    odd = records.select("item_id", F.explode(F.array_repeat(F.lit("odd"), F.col("odd"))).alias("path"), F.lit("accepted").alias("status"))
    decisions = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(odd)
    tally = V.Tally(records, {p: F.col(f"s{k}") for k, p in enumerate(PATHS)}, F.col("odd"))
    told = lambda frame: sorted((r.item_id, tuple(r.edited_fields), tuple(r.rejected_fields), r.status) for r in frame.collect())
    got, expected = tally.outcomes(), V.outcomes(leaves, decisions)
    assert told(got) == told(expected)
    assert got.dtypes == expected.dtypes
    assert {r.status for r in got.collect()} == {"accepted", "edited", "discarded"}
    bad = {r.item_id for r in V.completeness(leaves, decisions).collect()}
    assert {r.item_id: r.conformant for r in tally.conformant().collect()} == {r[0]: r[0] not in bad for r in rows}


@pytest.fixture(scope="module")
def lines(spark, sf_dir, tmp_path_factory):
    """Lines of which some are there twice or three times, and some of those with another flag, quantity or none."""
    folder = str(tmp_path_factory.mktemp("lines"))
    few = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(400)
    again = few.where("l_partkey % 3 = 1").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 2 == 0, "A").when(F.col("l_orderkey") % 3 == 0, "N")).withColumn("l_quantity", F.lit(None).cast("double"))
    few.union(again).union(again.where("l_orderkey % 5 = 0")).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def exchanges(query):
    """Exchanges and joins of the first plan, before any of it has run."""
    plan = query._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Join")


@pytest.mark.parametrize("name,most", [("lst_review_outcomes", 1), ("agg_conformant", 2)])
def test_a_record_is_exchanged_once(spark, lines, name, most):
    """Not its leaves, nor its decisions to meet them: those took 19 times the input on disk."""
    query = __spark_entry__.queries()[name](spark, lines)
    assert exchanges(query) == (most, 0)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{lines}/lineitem.parquet/*.parquet'")
        expected = db.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    plain = lambda rows: sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)
    assert plain(query.collect()) == plain(expected)
