"""Queries of the event-sequence operators and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import outcomes as O
from ..operators import sequences as S
from ..sources.views import events, matches, rosters, table
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

_PHASE = "case when tick >= 7920 then 'late' when tick >= 5280 then 'overtime' when tick >= 3360 then 'double' else 'single' end"
_LANE = "case when x < 7500 then 'left' when x > 10500 then 'right' else 'center' end"
SUMS = "count(*) as n, count(*) filter (result = 'win')::bigint as wins, count(*) filter (result = 'loss')::bigint as losses, count(*) filter (result = 'draw')::bigint as draws"

add("c1_matches_with_events", lambda s, d: matches(s, d).join(events(s, d).select("match_id"), "match_id", "left_semi").select("match_id", "result"),
    "select match_id, result from m where match_id in (select match_id from e)", "me")
_ORIENT = """o as (select *, count(*) filter (side = 'team') over p >= 3 and count(*) filter (side = 'opponent') over p >= 3 and avg(y) filter (side = 'team') over p <= avg(y) filter (side = 'opponent') over p as rotated
from e window p as (partition by match_id))"""
add("c2_orient", lambda s, d: S.orient(events(s, d)).select("event_id", "rotated", "x", "y"),
    f"with {_ORIENT} select event_id, coalesce(rotated, false) as rotated, case when rotated then 17325 - x else x end as x, case when rotated then 31500 - y else y end as y from o", "e")
add("j24_orientation_check", lambda s, d: S.orient(events(s, d)).groupBy("rotated", (F.col("match_id") % 2).alias("won")).agg(F.count_distinct("match_id").alias("n"), F.avg(F.when(F.col("side") == "team", F.col("y"))).alias("own_y")),
    f"with {_ORIENT} select rotated, match_id % 2 as won, count(distinct match_id) as n, avg(case when rotated then 31500 - y else y end) filter (side = 'team') as own_y from o group by 1, 2", "e")
add("c3_opening", lambda s, d: (lambda o: O.top_k(o.groupBy("won", "side", "item").agg(F.count(F.lit(1)).alias("n"), F.avg("first_tick").alias("tick")), ["won", "side"], [F.desc("n"), F.col("item")], 5))(
    events(s, d).groupBy("match_id", "side").agg(F.min_by("item", F.struct("tick", "event_id")).alias("item"), F.min("tick").alias("first_tick")).withColumn("won", F.col("match_id") % 2)),
    """with o as (select match_id % 2 as won, side, arg_min(item, (tick, event_id)) as item, min(tick) as first_tick from e group by match_id, side),
g as (select won, side, item, count(*) as n, avg(first_tick) as tick from o group by all) select *, row_number() over (partition by won, side order by n desc, item)::int as rank from g qualify rank <= 5""", "e")
add("c4_phase_profile", lambda s, d: (lambda p: p.withColumn("per_match", F.col("plays") / F.col("reached")))(
    events(s, d).withColumn("phase", X.phase("tick")).groupBy("phase", "side", (F.col("match_id") % 2).alias("won")).agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("match_id").alias("reached"), F.avg(F.when(X.lane("x") == "left", 1.0).otherwise(0.0)).alias("left_share"))),
    f"select {_PHASE} as phase, side, match_id % 2 as won, count(*) as plays, count(distinct match_id) as reached, avg(({_LANE} = 'left')::int::double) as left_share, count(*) / count(distinct match_id) as per_match from e group by 1, 2, 3", "e")
add("c5_mix", lambda s, d: (lambda g: g.select("item", *[(F.coalesce(F.col(c), F.lit(0)) / F.col("n")).alias(c) for c in ("left", "center", "right")]))(
    events(s, d).withColumn("lane", X.lane("x")).groupBy("item").pivot("lane", ["left", "center", "right"]).agg(F.count(F.lit(1))).join(events(s, d).groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item")),
    f"select item, count(*) filter ({_LANE} = 'left') / count(*) as \"left\", count(*) filter ({_LANE} = 'center') / count(*) as center, count(*) filter ({_LANE} = 'right') / count(*) as \"right\" from e group by item", "e")
add("c6_pair_within", lambda s, d: S.pair_within(events(s, d), "click", "view", 60).groupBy("paired").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("match_id") % 2).cast("double")).alias("rate")),
    """with a as (select match_id, tick from e where side = 'team' and item = 'click'), b as (select match_id, tick as t from e where side = 'team' and item = 'view'),
p as (select a.match_id, max((b.t is not null)::int) = 1 as paired from a left join b on a.match_id = b.match_id and abs(b.t - a.tick) <= 60 group by 1)
select paired, count(*) as n, avg((match_id % 2)::double) as rate from p group by 1""", "e")
_SESS = """f as (select *, case when tick - lag(tick) over w <= 300 then 0 else 1 end as fresh from e window w as (partition by match_id, side order by tick, event_id)),
g as (select *, sum(fresh) over (partition by match_id, side order by tick, event_id)::bigint as session from f),
s as (select match_id, side, session, min(tick) as start, max(tick) as "end", count(*) as n, sum(cost)::bigint as cost from g group by all having count(*) >= 3)"""
add("c7_sessionize", lambda s, d: S.sessionize(events(s, d), ["match_id", "side"], 300, 3), f"with {_SESS} select * from s", "e")
add("c8_push_stats", lambda s, d: events(s, d).select("match_id").distinct().join(S.sessionize(events(s, d), ["match_id", "side"], 300, 3), "match_id", "left").groupBy("match_id").agg(F.count("session").alias("pushes"), F.min("start").alias("first"), F.avg("n").alias("size")),
    f"with {_SESS} select k.match_id, count(session) as pushes, min(start) as first, avg(n) as size from (select distinct match_id from e) k left join s using (match_id) group by 1", "e")
add("c10_exchanges", lambda s, d: S.exchanges(events(s, d), 120),
    """select a.event_id, a.match_id, a.item, a.tick, count(b.tick) as responses, (coalesce(sum(b.cost), 0) - a.cost)::bigint as net from e a left join e b on b.match_id = a.match_id and b.side = 'opponent' and b.tick between a.tick and a.tick + 120
where a.side = 'team' group by a.event_id, a.match_id, a.item, a.tick, a.cost""", "e")
add("c11_exchange_stats", lambda s, d: S.exchanges(events(s, d), 120).groupBy("item", X.phase("tick").alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net"), 6).alias("mean"), F.round(F.stddev_pop("net"), 6).alias("sd"), F.percentile("net", F.lit(0.5)).alias("median")),
    f"""with x as (select a.event_id, a.item, a.tick, coalesce(sum(b.cost), 0) - a.cost as net from e a left join e b on b.match_id = a.match_id and b.side = 'opponent' and b.tick between a.tick and a.tick + 120
where a.side = 'team' group by a.event_id, a.item, a.tick, a.cost) select item, {_PHASE} as phase, count(*) as n, round(avg(net), 6) as mean, round(stddev_pop(net), 6) as sd, quantile_cont(net, 0.5) as median from x group by 1, 2""", "e")
add("c13_resource_trace", lambda s, d: S.resource_trace(events(s, d), F.lit(0.25), 10.0, 5.0))
add("c16_area_connect", lambda s, d: S.area_connect(events(s, d), "purchase", 200, 6000),
    """select a.event_id, max(b.cost) as value, nullif(count(b.cost), 0) as hits from e a left join e b on b.match_id = a.match_id and b.side = 'opponent' and b.tick between a.tick and a.tick + 200
and sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= 6000 where a.side = 'team' and a.item = 'purchase' group by 1""", "e")
ZONES = [("home", 0, 0, 8000, 15000, 1.0), ("centre", 5000, 10000, 12000, 21000, 2.0), ("away", 0, 20000, 17325, 31500, 3.0)]


def zone_hit(e, zones):
    """Name and weight of the first box that holds the point."""
    out = F.lit(None).cast("struct<zone:string,weight:double>")
    for name, x0, y0, x1, y1, weight in reversed(zones):
        out = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), F.struct(F.lit(name).alias("zone"), F.lit(weight).alias("weight"))).otherwise(out)
    return e.withColumn("_z", out).select("event_id", "_z.zone", "_z.weight")


_Z = "case " + " ".join(f"when x between {x0} and {x1} and y between {y0} and {y1} then {{{i}}}" for i, (_, x0, y0, x1, y1, _w) in enumerate(ZONES)) + " end"
add("c17_zone_hit", lambda s, d: zone_hit(events(s, d), ZONES), f"select event_id, {_Z.format(*(repr(z[0]) for z in ZONES))} as zone, {_Z.format(*(z[5] for z in ZONES))}::double as weight from e", "e")
_OPP = "(select match_id, tick as t, max(event_id) as other from e where side = 'opponent' group by 1, 2)"
_TEAM = "(select event_id, match_id, tick from e where side = 'team')"
_sides = lambda s, d: (events(s, d).where("side = 'team'").select("match_id", "event_id", "tick"), events(s, d).where("side = 'opponent'").groupBy("match_id", F.col("tick").alias("t")).agg(F.max("event_id").alias("other")))
add("d8_asof_backward", lambda s, d: S.asof_join(*_sides(s, d), ["match_id"], "tick", "t", ["other"]),
    f"select a.match_id, a.event_id, a.tick, b.t as t_hit, b.other from {_TEAM} a asof left join {_OPP} b on a.match_id = b.match_id and a.tick >= b.t", "e")
add("d8_asof_forward", lambda s, d: S.asof_join(*_sides(s, d), ["match_id"], "tick", "t", ["other"], backward=False),
    f"select a.match_id, a.event_id, a.tick, b.t as t_hit, b.other from {_TEAM} a asof left join {_OPP} b on a.match_id = b.match_id and a.tick <= b.t", "e")
add("d8_asof_strict", lambda s, d: S.asof_join(*_sides(s, d), ["match_id"], "tick", "t", ["other"], strict=True),
    f"select a.match_id, a.event_id, a.tick, b.t as t_hit, b.other from {_TEAM} a asof left join {_OPP} b on a.match_id = b.match_id and a.tick > b.t", "e")


def deliver(values, e):
    """Credits each value to the first event at or after its time, or to the match's last event if there is none."""
    hit = S.asof_join(values, e.groupBy("match_id", F.col("tick").alias("t")).agg(F.min("event_id").alias("to")), ["match_id"], "impact", "t", ["to"], backward=False)
    last = e.groupBy("match_id").agg(F.max_by("event_id", F.struct("tick", "event_id")).alias("last"))
    return hit.join(last, "match_id").groupBy("match_id", F.coalesce("to", "last").alias("event_id")).agg(F.sum("value").alias("value"))


add("c18_deliver", lambda s, d: deliver(events(s, d).where("item = 'error'").select("match_id", (F.col("tick") + 90).alias("impact"), F.col("cost").cast("long").alias("value")), events(s, d)),
    """with v as (select match_id, tick + 90 as impact, cost as value from e where item = 'error'), b as (select match_id, tick as t, min(event_id) as target from e group by 1, 2), l as (select match_id, arg_max(event_id, (tick, event_id)) as last from e group by 1),
h as (select v.*, b.target from v asof left join b on v.match_id = b.match_id and v.impact <= b.t) select match_id, coalesce(target, last) as event_id, sum(value)::bigint as value from h join l using (match_id) group by 1, 2""", "e")
add("c19_tag_hits", lambda s, d: (lambda a, b: a.join(S.range_join(a, b, ["match_id"], "tick", "t", -80, -1).select("event_id").distinct().withColumn("reactive", F.lit(1)), "event_id", "left").groupBy(F.coalesce("reactive", F.lit(0)).alias("reactive")).agg(F.count(F.lit(1)).alias("n")))(
    events(s, d).where("item = 'purchase'").select("match_id", "event_id", "tick"), events(s, d).where("side = 'opponent'").select("match_id", F.col("tick").alias("t"))),
    "select (exists (select 1 from e b where b.match_id = a.match_id and b.side = 'opponent' and b.tick between a.tick - 80 and a.tick - 1))::int as reactive, count(*) as n from e a where item = 'purchase' group by 1", "e")
_LAT = "max(tick) filter (side = 'opponent') over (partition by match_id order by tick range between unbounded preceding and 1 preceding)"
add("c20_timing", lambda s, d: S.timing(events(s, d)),
    f"""with t as (select *, tick - lag(tick) over (partition by match_id, side order by tick, event_id) as gap, tick - {_LAT} as latency from e)
select match_id, count(*) as n, quantile_cont(gap, 0.5) as gap_median, quantile_cont(gap, 0.25) as gap_p25, min(gap) as gap_min, avg((gap <= 20)::int::double) as burst, avg(latency) as latency from t where side = 'team' group by 1""", "e")
add("c21_previous_latency", lambda s, d: S.asof_join(*_sides(s, d), ["match_id"], "tick", "t", ["other"], strict=True).select("event_id", F.when(F.col("tick") - F.col("t_hit") <= 400, F.col("tick") - F.col("t_hit")).alias("latency")),
    f"select event_id, case when tick - p <= 400 then tick - p end as latency from (select *, max(tick) filter (side = 'opponent') over (partition by match_id order by tick range between unbounded preceding and 1 preceding) as p from e) where side = 'team'", "e")
add("c22_timing_spread", lambda s, d: S.timing(events(s, d)).join(events(s, d).where("side = 'team'").groupBy("match_id").agg(F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cost_cv")), "match_id").where("n >= 10").select("match_id", "gap_median", "burst", "cost_cv"),
    """with t as (select *, tick - lag(tick) over (partition by match_id, side order by tick, event_id) as gap from e) select match_id, quantile_cont(gap, 0.5) as gap_median, avg((gap <= 20)::int::double) as burst, round(stddev_pop(cost) / avg(cost), 6) as cost_cv from t where side = 'team' group by 1 having count(*) >= 10""", "e")
add("c23_latest_n", lambda s, d: O.top_k(matches(s, d).select("entity", "match_id", "ts"), ["entity"], [F.desc("ts"), F.desc("match_id")], 5).select("entity", "match_id", "rank"),
    "select entity, match_id, row_number() over (partition by entity order by ts desc, match_id desc)::int as rank from m qualify rank <= 5", "m")
add("c24_group_profile", lambda s, d: events(s, d).withColumn("turn", F.when(F.lag("side").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("match_id").orderBy("tick", "event_id")) != F.col("side"), 1.0).otherwise(0.0)).groupBy((F.col("match_id") % 7).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg("turn").alias("alternation"), F.avg("y").alias("mean_y"), F.avg(F.when(F.col("y") > 15750, 1.0).otherwise(0.0)).alias("aggression")),
    "select match_id % 7 as \"group\", count(*) as n, avg(coalesce((side != p)::int, 0)::double) as alternation, avg(y) as mean_y, avg((y > 15750)::int::double) as aggression from (select *, lag(side) over (partition by match_id order by tick, event_id) as p from e) group by 1", "e")
add("c25_opener_stats", lambda s, d: events(s, d).where("side = 'team'").groupBy("match_id").agg(F.min_by("item", F.struct("tick", "event_id")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("match_id") % 2).alias("wins")),
    "select item, count(*) as n, sum(match_id % 2)::bigint as wins from (select match_id, arg_min(item, (tick, event_id)) as item from e where side = 'team' group by 1) group by 1", "e")
add("c26_early_advantage", lambda s, d: events(s, d).where("tick < 3360").groupBy("match_id").agg(F.sum(F.when(F.col("side") == "team", F.col("cost")).otherwise(-F.col("cost"))).alias("diff")).agg(F.round(F.corr(F.col("diff").cast("double"), (F.col("match_id") % 2).cast("double")), 6).alias("r"), F.avg("diff").alias("mean")),
    "select round(corr(diff, match_id % 2), 6) as r, avg(diff) as mean from (select match_id, sum(case when side = 'team' then cost else -cost end) as diff from e where tick < 3360 group by 1)", "e")
add("c27_active_curve", lambda s, d: S.active_curve(events(s, d), 200, 50),
    "select match_id, side, \"at\", count(*) as alive, avg(x) as x from (select match_id, side, x, unnest(range((tick // 50) * 50, (tick // 50) * 50 + 201, 50))::bigint as \"at\" from e) group by all", "e")

# --- D: joins ------------------------------------------------------------------------------------------------------

add("d1_inner", lambda s, d: rosters(s, d).join(matches(s, d), "match_id").groupBy("item").agg(*O.outcome_sums()), f"select item, {SUMS} from r join m using (match_id) group by item", "mr")
add("d2_left_defaults", lambda s, d: matches(s, d).join(rosters(s, d).groupBy("match_id").agg(F.sum("cost").alias("cost")), "match_id", "left").select("match_id", F.coalesce("cost", F.lit(0)).alias("cost")),
    "select m.match_id, coalesce(c, 0)::bigint as cost from m left join (select match_id, sum(cost) as c from r group by 1) using (match_id)", "mr")
add("d3_anti", lambda s, d: matches(s, d).join(rosters(s, d), "match_id", "left_anti").select("match_id"), "select match_id from m where not exists (select 1 from r where r.match_id = m.match_id)", "mr")
add("d4_semi", lambda s, d: matches(s, d).join(rosters(s, d).where("item = 'Brand#13'"), "match_id", "left_semi").select("match_id"), "select match_id from m where match_id in (select match_id from r where item = 'Brand#13')", "mr")
add("d5_having", lambda s, d: matches(s, d).join(rosters(s, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 4"), "match_id").select("match_id", "k"), "select match_id, k from m join (select match_id, count(*) as k from r group by 1 having count(*) >= 4) using (match_id)", "mr")
add("d6_correlated_count", lambda s, d: matches(s, d).join(events(s, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 20"), "match_id").select("match_id", "k"), "select m.match_id, k from m, lateral (select count(*) as k from e where e.match_id = m.match_id) where k >= 20", "me")
add("d7_range_join", lambda s, d: S.range_join(events(s, d).select("match_id", "event_id", "tick"), events(s, d).select("match_id", F.col("event_id").alias("other"), F.col("tick").alias("t")), ["match_id"], "tick", "t", 1, 40).select("event_id", "other"),
    "select a.event_id, b.event_id as other from e a join e b on a.match_id = b.match_id and b.tick - a.tick between 1 and 40", "e")
add("d11_pairs", lambda s, d: (lambda r: r.join(r.select("match_id", F.col("item").alias("b")), "match_id").where("item < b").groupBy(F.col("item").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")))(rosters(s, d).where("is_player = 1").select("match_id", "item").distinct()),
    "with q as (select distinct match_id, item from r where is_player = 1) select x.item as a, y.item as b, count(*) as n from q x join q y on x.match_id = y.match_id and x.item < y.item group by 1, 2", "r")
add("d12_lookup", lambda s, d: table(s, d, "supplier").join(F.broadcast(table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name"),
    "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
