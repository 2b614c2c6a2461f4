"""Match, roster and event views over the test tables, in Spark and as SQL.

Matches M (match_id, ts, kind, corpus, entity, opponent, result, own_score, opp_score, own_rating, opp_rating, change),
rosters R (match_id, item, is_player, item_type, cost), events E (match_id, event_id, side, item, tick, x, y, cost, k, ts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    win, loss = F.col("result") == "win", F.col("result") == "loss"
    key = F.col("o_orderkey")
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .withColumn("result", F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("draw"))
        .select(
            key.alias("match_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_orderpriority").alias("kind"),
            F.col("c_mktsegment").alias("corpus"),
            F.col("o_custkey").alias("entity"),
            ((key * 7 + F.col("o_custkey")) % 100).alias("opponent"),
            "result",
            F.when(win, 1 + key % 3).when(loss, key % 2).otherwise(1).cast("long").alias("own_score"),
            F.when(win, 0).when(loss, 1 + key % 2).otherwise(1).cast("long").alias("opp_score"),
            F.floor(F.col("o_totalprice") / 20).cast("int").alias("own_rating"),
            F.floor("c_acctbal").cast("int").alias("opp_rating"),
            F.when(win, 30).when(loss, -30).otherwise(0).alias("change"),
        )
    )


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (
        line.join(p, line["l_partkey"] == p["p_partkey"])
        .select(
            F.col("l_orderkey").alias("match_id"),
            F.col("p_brand").alias("item"),
            (F.col("l_linenumber") % 2).cast("int").alias("is_player"),
            F.col("p_type").alias("item_type"),
            (1 + F.col("p_size") % 9).cast("int").alias("cost"),
        )
        .distinct()
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.col("ts").cast("timestamp").cast("double") - F.lit("2024-01-01 00:00:00").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("match_id"),
        "event_id",
        F.when(F.col("event_type").isin("click", "view", "purchase"), "team").otherwise("opponent").alias("side"),
        F.col("event_type").alias("item"),
        F.floor(seconds / 250).cast("int").alias("tick"),
        (k * 175).alias("x"),
        (F.floor(F.col("value") * 64) % 31500).cast("int").alias("y"),
        (1 + k % 9).alias("cost"),
        k.alias("k"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


M_SQL = """m as (
  select o_orderkey as match_id, o_orderdate as ts, o_orderpriority as kind, c_mktsegment as corpus, o_custkey as entity,
    (o_orderkey * 7 + o_custkey) % 100 as opponent,
    case o_orderstatus when 'F' then 'win' when 'O' then 'loss' else 'draw' end as result,
    case o_orderstatus when 'F' then 1 + o_orderkey % 3 when 'O' then o_orderkey % 2 else 1 end::bigint as own_score,
    case o_orderstatus when 'F' then 0 when 'O' then 1 + o_orderkey % 2 else 1 end::bigint as opp_score,
    floor(o_totalprice / 20)::int as own_rating, floor(c_acctbal)::int as opp_rating,
    case o_orderstatus when 'F' then 30 when 'O' then -30 else 0 end as change
  from orders join customer on c_custkey = o_custkey
)"""
R_SQL = """r as (
  select distinct l_orderkey as match_id, p_brand as item, (l_linenumber % 2)::int as is_player, p_type as item_type, (1 + p_size % 9)::int as cost
  from lineitem join part on p_partkey = l_partkey
)"""
E_SQL = """e as (
  select user_id as match_id, event_id, case when event_type in ('click', 'view', 'purchase') then 'team' else 'opponent' end as side,
    event_type as item, floor(epoch(ts - timestamp '2024-01-01 00:00:00') / 250)::int as tick,
    json_extract_string(props, '$.k')::int * 175 as x, (floor(value * 64)::bigint % 31500)::int as y,
    1 + json_extract_string(props, '$.k')::int % 9 as cost, json_extract_string(props, '$.k')::int as k, ts
  from events
)"""
