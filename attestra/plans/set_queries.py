"""Set operations, lookups and latest rows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def prj_without_excluded(spark, sf_dir):
    """PRJ-14, JON-12."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.where("toxic = 1"), "doc_id", "left_anti").join(labels, "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("labelled"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_common(spark, sf_dir):
    """SET-05, JON-13."""
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_remaining(spark, sf_dir):
    """SET-03, SRC-47: what has no result yet."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part WHERE p_type LIKE 'E%' UNION SELECT 'extra'")
def set_named(spark, sf_dir):
    """SET-04, SET-06."""
    p = table(spark, sf_dir, "part")
    extra = spark.createDataFrame([("extra",)], "name string")
    return p.select(F.col("p_brand").alias("name")).union(p.where("p_type LIKE 'E%'").select("p_type")).union(extra).distinct()


@query("SELECT 'A' AS section, l_orderkey AS slug, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'late', l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01'")
def set_sections(spark, sf_dir):
    """SET-01, SET-07."""
    n = table(spark, sf_dir, "lineitem")
    part = lambda name, rows: rows.select(F.lit(name).alias("section"), F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("n"))
    return part("A", n.where("l_returnflag = 'A'")).unionByName(part("late", n.where("l_shipdate > TIMESTAMP_NTZ '2001-01-01'")))


@query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS whole, count(*) AS n FROM conversations GROUP BY conv_id")
def set_ordered_text(spark, sf_dir):
    """SET-08."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda t: t["text"]), " ")).alias("whole"), F.count("*").alias("n"))


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM i GROUP BY user_id, event_type, island""")
def win_runs(spark, sf_dir):
    """WIN-12."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("turn", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(1)))
    return e.withColumn("island", F.sum("turn").over(w)).groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("island")


@query("""SELECT c_custkey, coalesce(o_orderkey, -1) AS answer FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def jon_lookup_with_default(spark, sf_dir):
    """SRC-34: a lookup with a default."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("answer"))


@query("""WITH s AS (SELECT user_id, date_trunc('day', ts) AS sample, sum(value) AS total FROM events GROUP BY ALL) SELECT user_id, round(max(total), 6) AS peak FROM s GROUP BY user_id""")
def agg_peak_of_sums(spark, sf_dir):
    """AGG-17."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("sample")).agg(F.sum("value").alias("total"))
    return s.groupBy("user_id").agg(F.round(F.max("total"), 6).alias("peak"))


@query("""WITH l AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS loaded FROM events GROUP BY ALL) SELECT user_id, round(least(1.0, sum(loaded) / (count(*) * 50)), 9) AS fraction FROM l GROUP BY user_id""")
def agg_progress(spark, sf_dir):
    """AGG-25, SRC-48: the latest of each file, then their share."""
    latest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("loaded"))
    return latest.groupBy("user_id").agg(F.round(F.least(F.lit(1.0), F.sum("loaded") / (F.count("*") * 50)), 9).alias("fraction"))


@query("""SELECT p_brand AS family, min_by(p_size || '.' || p_partkey % 12, (p_size, p_partkey % 12)) AS version FROM part GROUP BY p_brand""")
def agg_lowest_version(spark, sf_dir):
    """AGG-26, MTH-11."""
    from attestra.functions.numbers import version_parts

    version = F.concat_ws(".", "p_size", F.col("p_partkey") % 12)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg(F.min_by(version, version_parts(version)).alias("version"))


@query("""SELECT url, bool_or(page_id % 3 = 0) AND bool_or(page_id % 3 = 1 OR length(html) > 2000) AS cached FROM pages GROUP BY url""")
def src_model_cached(spark, sf_dir):
    """SRC-36: both parts of a model are there."""
    return table(spark, sf_dir, "pages").groupBy("url").agg((F.bool_or(F.col("page_id") % 3 == 0) & F.bool_or((F.col("page_id") % 3 == 1) | (F.length("html") > 2000))).alias("cached"))
