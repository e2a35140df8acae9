"""Queries of streams, saved state and learned classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators import scores
from pluvia.plans.nowcasts import _drained, _events_stream, _scratch
from pluvia.plans.registry import ORACLES, QUERIES, query
from pluvia.plans.scores import _HMF, _M
from pluvia.sources import driver_tables as src
from pluvia.sources import matrix, sinks
from pluvia.streaming import collector

_T = "floor(epoch(ts))::BIGINT * 100000 + event_id % 100000"


@query(f"""WITH f AS (SELECT (user_id % 12)::INT AS region, {_T} AS t, value > 400 AS rainy FROM events), w AS (SELECT *, coalesce(max(CASE WHEN rainy THEN t END) OVER p, -1) AS last_rain, row_number() OVER (PARTITION BY region ORDER BY t) AS checked FROM f WINDOW p AS (PARTITION BY region ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN last_rain < 0 THEN checked >= 2 ELSE t - last_rain > 21600::BIGINT * 100000 END AS given_up FROM w""")
def col_region_state(spark: SparkSession, d: str) -> DataFrame:
    """The collector's state after every frame, drained once."""
    t = src.epoch(F.col("ts")) * 100000 + F.col("event_id") % 100000
    e = _events_stream(spark, d).select((F.col("user_id") % 12).cast("int").alias("region"), t.alias("t"), (F.col("value") > 400).alias("rainy"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, collector.region_state(e, 21600 * 100000))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type AS source, count(*) AS n, round(sum(value), 4) AS weight FROM events GROUP BY ALL""")
def stm_hourly_load(spark: SparkSession, d: str) -> DataFrame:
    """Every window, the last ones too: the newest row of each from a stream in update mode."""
    e = _events_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("value").alias("weight"))
    rows = collector.latest_rows(collector.windowed_load(e), ["start", "source"], _scratch(spark))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "source", "n", F.round("weight", 4).alias("weight"))


QUERIES["stm_windowed_load"], ORACLES["stm_windowed_load"] = stm_hourly_load, ORACLES["stm_hourly_load"]  # the same by its older name


@query(f"""{_M}, b AS (SELECT region, t // 21600 AS block, variant, {_HMF} FROM m GROUP BY ALL), c AS (SELECT max(t) // 2 AS cut FROM m) SELECT * EXCLUDE (cut) FROM b, c WHERE block * 21600 + 21600 >= cut""")
def snk_saved_state(spark: SparkSession, d: str) -> DataFrame:
    """Accumulators saved in two runs, the second replacing the blocks that both have, read back
    within a cutoff."""
    m = src.members(spark, d)
    blocks = scores.block_counts(m)
    path = f"{_scratch(spark)}/state"
    sinks.save_state(blocks.withColumn("hits", F.col("hits") + 1).where("block % 2 = 0"), path)
    sinks.save_state(blocks, path)
    cut = m.agg(F.max("t")).first()[0] // 2
    return sinks.retained(sinks.load_state(spark, path, blocks.schema), cut).select(*blocks.columns)


@query()
def trn_gbt(spark: SparkSession, d: str) -> DataFrame:
    """(fold, lead, n, events, brier, base): boosted trees for rain, trained on one half of the regions and
    scored on the other, against the lead's base rate."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    said = [F.max(F.when(F.col("variant") == v, F.col("fc"))).alias(v) for v in src.VARIANTS]
    label = (F.max(F.when(F.col("variant") == "LK", F.col("obs"))) >= 20).cast("double").alias("label")
    m = src.members(spark, d).where("point IS NOT NULL AND lead IS NOT NULL").groupBy("region", "point", "lead").agg(*said, label).na.fill(-32.0, src.VARIANTS)
    path = f"{_scratch(spark)}/rows"  # every step of the training reads them
    m.write.parquet(path)
    rows = VectorAssembler(inputCols=[*src.VARIANTS, "lead"], outputCol="features").transform(spark.read.parquet(path))
    out = None
    for fold in (0, 1):
        model = GBTClassifier(maxIter=5, maxDepth=4, seed=1, subsamplingRate=0.7).fit(rows.where(F.col("region") % 2 != fold))
        held = model.transform(rows.where(F.col("region") % 2 == fold)).select("lead", "label", vector_to_array("probability")[1].alias("p"))
        s = held.groupBy("lead").agg(F.count("*").alias("n"), F.sum("label").alias("events"), F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"), (F.avg("label") * (1 - F.avg("label"))).alias("base")).select(F.lit(fold).alias("fold"), "*")
        out = s if out is None else out.unionByName(s)
    return out


@query("""WITH r AS (SELECT (least(l_linenumber, 6) * 10)::FLOAT AS lead, l_quantity::FLOAT AS m_lk, round(l_discount * 100)::FLOAT AS near, round(l_tax * 100)::FLOAT AS obs FROM lineitem)
SELECT lead::DOUBLE AS lead, count(*) AS n, count(*) FILTER (WHERE near IS NULL OR near = 0) AS missing, sum(m_lk::DOUBLE) AS m_lk, sum(obs::DOUBLE) AS obs FROM r GROUP BY lead""")
def snk_training_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Training rows written as raw matrices and read back by column."""
    matrix.register(spark)
    li = src.table(spark, d, "lineitem")
    near = F.nullif(F.round(F.col("l_discount") * 100), F.lit(0.0))
    rows = li.select((F.least(F.col("l_linenumber"), F.lit(6)) * 10).cast("float").alias("lead"), F.col("l_quantity").cast("float").alias("m_lk"), near.cast("float").alias("near"), F.lit(0.0).cast("float").alias("unread"), F.round(F.col("l_tax") * 100).cast("float").alias("obs"))
    path = f"{_scratch(spark)}/matrix".removeprefix("file://")
    rows.write.format("f32matrix").mode("append").save(path)
    got = spark.read.format("f32matrix").option("columns", "lead,m_lk,near,obs").load(path)
    total = lambda c: F.sum(F.col(c).cast("double")).alias(c)
    return got.groupBy(F.col("lead").cast("double").alias("lead")).agg(F.count("*").alias("n"), F.count_if(F.isnan("near")).alias("missing"), total("m_lk"), total("obs"))
