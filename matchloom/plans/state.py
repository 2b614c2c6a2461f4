"""Queries of the basket, dimension, vector and evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import baskets as B
from ..operators import dimensions as D
from ..operators import outcomes as O
from ..operators import ranges
from ..sources.views import R_SQL, events, matches, rosters, table
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

SUMS = "count(*) as n, count(*) filter (result = 'win')::bigint as wins, count(*) filter (result = 'loss')::bigint as losses, count(*) filter (result = 'draw')::bigint as draws"
_BASKETS = "b as (select match_id, list(distinct item order by item) as items from r where is_player = 1 group by match_id)"

# --- F: baskets ---------------------------------------------------------------------------------------------------

add("f1_beta_posterior", lambda s, d: B.beta_posterior(O.win_rate(matches(s, d), ["kind", "corpus"]).select("kind", "corpus", "wins", "losses"), 10, intervals=False),
    "select kind, corpus, wins, losses, (wins + 1) / (wins + losses + 2) as mean from (select kind, corpus, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses from m group by all) where wins + losses >= 10", "m")
add("f1_beta_interval", lambda s, d: B.beta_posterior(O.win_rate(matches(s, d), ["entity"]).select("entity", "wins", "losses"), 1))
add("f2_rank_threats", lambda s, d: (lambda p: p.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy("mean", "kind"))))(B.beta_posterior(O.win_rate(matches(s, d), ["corpus", "kind"]).select("corpus", "kind", "wins", "losses"), 5, intervals=False)),
    "select *, row_number() over (partition by corpus order by mean, kind)::int as rank from (select corpus, kind, wins, losses, (wins + 1) / (wins + losses + 2) as mean from (select kind, corpus, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses from m group by all) where wins + losses >= 5)", "m")
add("f3_sample_beta", lambda s, d: B.sample_beta(O.win_rate(matches(s, d), ["kind"]).select("kind", "wins", "losses"), 50, 7))
add("f4_item_posteriors", lambda s, d: B.beta_posterior(O.item_matchups(matches(s, d), rosters(s, d), 1).select("item", "wins", "losses"), 10, intervals=False),
    "select item, wins, losses, (wins + 1) / (wins + losses + 2) as mean from (select item, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses from m join (select distinct match_id, item from r where is_player = 0) using (match_id) group by item) where wins + losses >= 10", "mr")
add("f5_cooccurrence", lambda s, d: B.cooccurrence(rosters(s, d), 3),
    "with q as (select distinct match_id, is_player, item from r) select x.item as a, y.item as b, count(*) as n from q x join q y on x.match_id = y.match_id and x.is_player = y.is_player and x.item < y.item group by 1, 2 having count(*) >= 3", "r")
add("f6_compositions", lambda s, d: B.compositions(matches(s, d), O.baskets(rosters(s, d))),
    f"with {_BASKETS} select array_to_string(items, '|') as basket, count(*) as n, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses from m join b using (match_id) group by 1", "mr")
add("f7_greedy_clusters", lambda s, d: B.greedy_clusters(B.basket_counts(rosters(s, d), table(s, d, "part").select(F.col("p_brand").alias("item"))).withColumn("anchor", F.element_at("items", 1)), "anchor", 0.55).select("anchor", F.array_join("items", "|").alias("basket"), "n", "cluster"),
    f"""with recursive {R_SQL}, {_BASKETS}, c as (select items[1] as anchor, items, count(*) as n from b group by 2), o as (select *, row_number() over (partition by anchor order by n desc, array_to_string(items, chr(31))) as i from c),
g as (select distinct anchor, 0::bigint as i, []::varchar[][] as founders, []::varchar[] as items, 0::bigint as n, 0::bigint as cluster from c
 union all select anchor, i, case when hit > 0 then founders else list_append(founders, items) end, items, n, case when hit > 0 then hit - 1 else len(founders) end
 from (select g.anchor, o.i, g.founders, o.items, o.n, coalesce(list_position(list_transform(g.founders, lambda f: len(list_intersect(f, o.items)) >= 0.55 * len(list_distinct(list_concat(f, o.items)))), true), 0) as hit from g join o on o.anchor = g.anchor and o.i = g.i + 1))
select anchor, array_to_string(items, '|') as basket, n, cluster::int as cluster from g where i > 0""")


def _sets(s, d):
    return O.baskets(rosters(s, d)).where(F.size("items") >= 3).groupBy("items").agg(F.min("match_id").alias("id"))


add("f8_jaccard_join", lambda s, d: B.jaccard_join(_sets(s, d), 0.6),
    f"with {_BASKETS}, q as (select items, min(match_id) as id from b where len(items) >= 3 group by items) select x.id as a, y.id as b, len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items))) as jaccard from q x join q y on x.id < y.id where len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items) - len(list_intersect(x.items, y.items))) >= 0.6", "r")
add("b15_combinations", lambda s, d: B.combinations(O.baskets(rosters(s, d)).withColumnRenamed("match_id", "id"), 3),
    "with q as (select distinct match_id, item from r where is_player = 1) select x.match_id as id, x.item || '|' || y.item || '|' || z.item as combo from q x join q y on x.match_id = y.match_id and x.item < y.item join q z on y.match_id = z.match_id and y.item < z.item", "r")
add("e25_basket_items", lambda s, d: O.baskets(rosters(s, d)).groupBy(X.basket_hash(F.col("items")).alias("hash")).agg(F.min("match_id").alias("example"), F.max(F.size("items")).alias("size")),
    "select hash, min(match_id) as example, max(size) as size from (select match_id, substr(md5(string_agg(distinct item, '|' order by item)), 1, 16) as hash, count(distinct item) as size from r where is_player = 1 group by match_id) group by hash", "r")
add("f12_activity_profile", lambda s, d: events(s, d).groupBy("match_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")),
    "select match_id, hour(ts)::int as hour, (isodow(ts) - 1)::int as day, count(*) as n from e group by 1, 2, 3", "e")
add("f11_zscore", lambda s, d: (lambda v: v.select("vec_id", F.round(F.when(F.col("sd") > 0, (F.col("x") - F.col("mean")) / F.col("sd")).otherwise(0.0), 6).alias("z")))(
    (lambda v: v.join(F.broadcast(v.groupBy("label").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))), "label"))(table(s, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x")))),
    "select vec_id, round((x - avg(x) over w) / stddev_pop(x) over w, 6) + 0.0 as z from (select vec_id, label, embedding[1]::double as x from embeddings) window w as (partition by label)")
add("f17_context", lambda s, d: matches(s, d).select("match_id", F.when(F.col("opp_rating") > 0, (F.col("own_rating") - F.col("opp_rating")) / 1000.0).otherwise(0.0).alias("gap"), F.when(F.col("opp_rating") > 0, F.least(F.col("own_rating") / F.col("opp_rating"), F.lit(6.0)) / 6).otherwise(0.0).alias("ratio")),
    "select match_id, case when opp_rating > 0 then (own_rating - opp_rating) / 1000.0::double else 0 end as gap, case when opp_rating > 0 then least(own_rating / opp_rating, 6.0::double) / 6 else 0 end as ratio from m", "m")
add("f18_mask_rows", lambda s, d: rosters(s, d).select("match_id", "item", F.when(F.pmod(F.xxhash64("match_id", F.lit(5)), F.lit(1_000_000)) < 150_000, None).otherwise(F.col("cost")).alias("cost")))

# --- G: dimensions -------------------------------------------------------------------------------------------------

_round = lambda df: df.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in df.dtypes])  # interpolation differs in the last bits
add("g1_quantiles", lambda s, d: _round(D.quantiles(matches(s, d), ["kind"], "own_rating", [0.1, 0.5, 0.9])),
    "select kind, count(*) as n, round(quantile_cont(own_rating, 0.1), 4) as p10, round(quantile_cont(own_rating, 0.5), 4) as p50, round(quantile_cont(own_rating, 0.9), 4) as p90 from m group by kind", "m")
_H = "select entity, min(ts) as first_ts, max(ts) as last_ts, arg_max(kind, (ts, match_id)) as name, count(*) as n, bool_or(result = 'win') as ever_won, max(match_id) as mark from m group by entity"
add("g2_harvest_incremental", lambda s, d: (lambda m: D.merge_harvest(D.harvest(m.where("match_id % 2 = 0")), D.harvest(m.where("match_id % 2 = 1"))).drop("last_at"))(matches(s, d)), _H, "m")
add("g3_group_measures", lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.percentile("c_acctbal", F.lit(0.5)).alias("median"), F.count_if(F.col("c_acctbal") >= 5000).alias("over"), F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best")),
    "select c_nationkey, max(c_acctbal) as top, round(avg(c_acctbal), 4) as mean, quantile_cont(c_acctbal, 0.5) as median, count(*) filter (c_acctbal >= 5000) as over, arg_max(c_custkey, (c_acctbal, c_custkey)) as best from customer group by 1")
add("g4_level_reference", lambda s, d: _round(D.quantiles(matches(s, d).join(rosters(s, d).groupBy("match_id").agg(F.max("cost").alias("level")), "match_id"), ["level"], "own_rating", [0.1, 0.5])),
    "select level, count(*) as n, round(quantile_cont(own_rating, 0.1), 4) as p10, round(quantile_cont(own_rating, 0.5), 4) as p50 from m join (select match_id, max(cost) as level from r group by 1) using (match_id) group by level", "mr")
add("g5_top_level", lambda s, d: matches(s, d).join(rosters(s, d), "match_id").groupBy("entity").agg(F.max(X.displayed_level("cost", F.lit(9), 15)).alias("level")), "select entity, max(cost + 6) as level from m join r using (match_id) group by 1", "mr")
add("g6_player_dim", lambda s, d: matches(s, d).groupBy(F.col("opponent").alias("entity")).agg(F.count_if(F.expr("result = 'loss'")).alias("wins"), F.count_if(F.expr("result = 'win'")).alias("losses"), F.min("match_id").alias("first"), F.max_by("kind", F.struct("ts", "match_id")).alias("last_kind"), (F.max("opp_rating") - F.percentile("opp_rating", F.lit(0.5))).alias("gap")),
    "select opponent as entity, count(*) filter (result = 'loss') as wins, count(*) filter (result = 'win') as losses, min(match_id) as first, arg_max(kind, (ts, match_id)) as last_kind, max(opp_rating) - quantile_cont(opp_rating, 0.5) as gap from m group by 1", "m")
add("g7_next_batch", lambda s, d: D.next_batch(D.harvest(matches(s, d)).select("entity", "n", "mark"), [F.desc("n"), F.asc("mark"), F.asc("entity")], 20), "select entity, n, mark from (select entity, count(*) as n, max(match_id) as mark from m group by 1) order by n desc, mark, entity limit 20", "m")
add("g9_top_of_band", lambda s, d: (lambda l: l.join(F.broadcast(l.groupBy("band").agg(F.percentile("own_rating", F.lit(0.9)).alias("edge"))), "band").where("own_rating >= edge"))(
    O.latest_by(matches(s, d).select("entity", "ts", "match_id", "own_rating"), ["entity"], ["ts", "match_id"]).select("entity", "own_rating", X.edge_bucket("own_rating", [5000, 10000, 15000]).alias("band"))),
    """with l as (select entity, own_rating, ((own_rating >= 5000)::int + (own_rating >= 10000)::int + (own_rating >= 15000)::int) as band from m qualify row_number() over (partition by entity order by ts desc, match_id desc) = 1)
select l.band, entity, own_rating, edge from l join (select band, quantile_cont(own_rating, 0.9) as edge from l group by band) q on l.band = q.band where own_rating >= edge""", "m")
_state = lambda s, d: table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("source"))
add("g10_reseed", lambda s, d: D.reseed(_state(s, d), matches(s, d).where("result = 'win'").select("entity"), ["BUILDING"]),
    """with st as (select c_custkey as entity, c_mktsegment as source from customer where c_custkey % 2 = 0), sd as (select distinct entity from m where result = 'win')
select coalesce(st.entity, sd.entity) as entity, coalesce(source, 'seed') as source, sd.entity is not null or coalesce(source = 'BUILDING', false) as active from st full join sd on st.entity = sd.entity""", "m")
add("g11_upsert_range", lambda s, d: D.upsert_range(_state(s, d).select("entity", F.lit(5000).alias("low"), F.lit(6000).alias("high")), matches(s, d).select("entity", F.col("own_rating").alias("rating"))),
    "select coalesce(c_custkey, entity) as entity, least(case when c_custkey is not null then 5000 end, lo) as low, greatest(case when c_custkey is not null then 6000 end, hi) as high from (select c_custkey from customer where c_custkey % 2 = 0) full join (select entity, min(own_rating) as lo, max(own_rating) as hi from m group by 1) on c_custkey = entity", "m")
add("g12_discover", lambda s, d: D.discover(_state(s, d).select("entity"), matches(s, d), 2000, 25),
    "select opponent as entity, count(*) as n, max(opp_rating) as rating from m where opponent not in (select c_custkey from customer where c_custkey % 2 = 0) group by 1 having max(opp_rating) is null or max(opp_rating) <= 0 or max(opp_rating) >= 2000 order by n desc, entity limit 25", "m")
add("g13_discover_losses", lambda s, d: matches(s, d).where("result = 'loss'").select(F.col("opponent").alias("entity")).distinct().join(_state(s, d), "entity", "left_anti"),
    "select distinct opponent as entity from m where result = 'loss' and opponent not in (select c_custkey from customer where c_custkey % 2 = 0)", "m")
add("g14_hygiene", lambda s, d: matches(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.percentile("own_rating", F.lit(0.5)).alias("median"), F.max("ts").alias("last")).select("entity", F.when(F.col("n") >= 25, "busy").when(F.col("last") < F.lit("1998-01-01").cast("timestamp"), "dormant").when(F.col("median") < 5000, "below").otherwise("keep").alias("flag")),
    "select entity, case when count(*) >= 25 then 'busy' when max(ts) < timestamp '1998-01-01' then 'dormant' when quantile_cont(own_rating, 0.5) < 5000 then 'below' else 'keep' end as flag from m group by 1", "m")
add("g15_select_batch", lambda s, d: D.select_batch(D.harvest(matches(s, d)).select("entity", (F.col("entity") % 10 == 0).alias("priority"), F.col("n").alias("score"), (-F.col("mark")).alias("age")), 30).select("entity", "slot", "rank"))
add("g16_inventory", lambda s, d: matches(s, d).join(_state(s, d), "entity", "left_semi").where(F.col("ts") >= F.lit("1997-01-01").cast("timestamp")).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(20),
    "select entity, count(*) as n from m where entity % 2 = 0 and entity in (select c_custkey from customer) and ts >= timestamp '1997-01-01' group by 1 order by n desc, entity limit 20", "m")
add("g17_mark_stale", lambda s, d: matches(s, d).select("match_id", F.when((F.col("result") == "draw") & (F.col("ts") < F.lit("1996-01-01").cast("timestamp")), 2).when(F.col("result") == "draw", 0).otherwise(1).alias("state")),
    "select match_id, case when result = 'draw' and ts < timestamp '1996-01-01' then 2 when result = 'draw' then 0 else 1 end as state from m", "m")
add("g18_snapshot_diff", lambda s, d: D.snapshot_diff(matches(s, d), "entity", ["ts", "match_id"], ["own_rating", "own_score"]),
    "select entity, own_rating - r1 as d_own_rating, own_score - s1 as d_own_score from (select entity, own_rating, own_score, lag(own_rating) over w as r1, lag(own_score) over w as s1, row_number() over (partition by entity order by ts desc, match_id desc) as i, count(*) over (partition by entity) as z from m window w as (partition by entity order by ts, match_id)) where i = 1 and z > 1", "m")
add("g19_incremental_equals_full", lambda s, d: (lambda m: (lambda a, b: a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differences")))(D.merge_harvest(D.harvest(m.where("match_id % 3 = 0")), D.harvest(m.where("match_id % 3 != 0"))).drop("last_at"), D.harvest(m).drop("last_at")))(matches(s, d)), "select count(*) as differences from m where false", "m")
add("g20_touch", lambda s, d: D.touch(_state(s, d).select("entity", F.lit(3).cast("long").alias("visits"), F.lit("1996-06-01").cast("timestamp").alias("last_ts")), matches(s, d)),
    "select c_custkey as entity, 3 + count(m.entity) as visits, greatest(timestamp '1996-06-01', max(ts)) as last_ts from customer left join m on m.entity = c_custkey where c_custkey % 2 = 0 group by 1", "m")

# --- J: vectors and evaluation ----------------------------------------------------------------------------------------


def _score(s, d):
    """(doc_id, p, label, step): a score in [0, 1] and a label from documents and labels."""
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("p"), F.col("quality").alias("label"), "lang")


_S = "s as (select doc_id, least(n_chars, 5000) / 5000 as p, quality as label, lang from documents join labels using (doc_id))"


add("j9_auc", lambda s, d: ranges.auc(_score(s, d), "p", F.col("label") == 1).select(F.round("auc", 9).alias("auc")),
    f"with {_S}, g as (select p, sum(label) as pos, count(*) as n from s group by p), w as (select *, coalesce(sum(n - pos) over (order by p rows between unbounded preceding and 1 preceding), 0) as b from g) select round(sum(pos * (b + 0.5 * (n - pos))) / (sum(pos) * sum(n - pos)), 9)::double as auc from w")


def reliability(df, n):
    """Per equal-width bin [low, high): count, mean score, mean label; a score of exactly 1 falls in none."""
    return df.where("p < 1").groupBy(F.floor(F.col("p") * n).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("score"), F.round(F.avg("label"), 9).alias("rate"))


add("j8_reliability", lambda s, d: reliability(_score(s, d), 10), f"with {_S} select floor(p * 10)::int as bin, count(*) as n, round(avg(p), 9) as score, round(avg(label), 9) as rate from s where p < 1 group by 1")
add("j8_ece", lambda s, d: reliability(_score(s, d), 10).agg(F.round(F.sum(F.col("n") * F.abs(F.col("score") - F.col("rate"))) / F.sum("n"), 6).alias("ece")),
    f"with {_S}, b as (select floor(p * 10)::int as bin, count(*) as n, avg(p) as score, avg(label) as rate from s where p < 1 group by 1) select round(sum(n * abs(score - rate)) / sum(n), 6) as ece from b")
add("j13_tier_calibration", lambda s, d: _score(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("score"), F.avg("label").alias("rate"), F.count_if((F.col("p") > 0.9) | (F.col("p") < 0.1)).alias("confident")),
    f"with {_S} select lang, count(*) as n, round(avg(p), 9) as score, avg(label) as rate, count(*) filter (p > 0.9 or p < 0.1) as confident from s group by 1")
add("j23_tilt", lambda s, d: matches(s, d).withColumn("losses", F.sum(O.is_("loss")).over(Window.partitionBy("entity").orderBy("ts", "match_id").rowsBetween(-9, 0))).select("entity", "match_id", "losses", F.when(F.col("losses") >= 7, "tilted").when(F.col("losses") >= 5, "warning").otherwise("calm").alias("level")),
    "select entity, match_id, k as losses, case when k >= 7 then 'tilted' when k >= 5 then 'warning' else 'calm' end as level from (select *, sum((result = 'loss')::int) over (partition by entity order by ts, match_id rows between 9 preceding and current row)::bigint as k from m)", "m")
add("j25_scan_features", lambda s, d: table(s, d, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.count_if(F.isnan("x") | F.col("x").isNull()).alias("bad"), F.min("x").alias("low"), F.max("x").alias("high")),
    "select dim::int as dim, count(*) filter (x is null or isnan(x)) as bad, min(x) as low, max(x) as high from (select unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) group by 1")
_P = "p as (select match_id, event_id, tick, item, side, (k + 1) / 102 as p from e)"
_wp = lambda s, d: events(s, d).select("match_id", "event_id", "tick", "item", "side", ((F.col("k") + 1) / 102).alias("p"))
_delta = lambda s, d: _wp(s, d).withColumn("wpa", F.col("p") - F.coalesce(F.lag("p").over(Window.partitionBy("match_id").orderBy("tick", "event_id")), F.lit(0.5)))
_W = f"{_P}, w as (select *, p - coalesce(lag(p) over (partition by match_id order by tick, event_id), 0.5) as wpa from p)"
add("i9_wpa", lambda s, d: _delta(s, d).select("event_id", F.round("wpa", 9).alias("wpa"), F.round(F.abs("wpa"), 9).alias("criticality")), f"with {_W} select event_id, round(wpa, 9)::double as wpa, round(abs(wpa), 9)::double as criticality from w", "e")
add("i10_wp_summary", lambda s, d: _delta(s, d).groupBy("match_id").agg(F.min_by("p", F.struct("tick", "event_id")).alias("first"), F.max_by("p", F.struct("tick", "event_id")).alias("last"), F.max("p").alias("high"), F.round(F.stddev_pop("wpa"), 6).alias("volatility")),
    f"with {_W} select match_id, arg_min(p, (tick, event_id)) as first, arg_max(p, (tick, event_id)) as last, max(p) as high, round(stddev_pop(wpa), 6) as volatility from w group by 1", "e")
add("e21_impact_by_side", lambda s, d: _delta(s, d).groupBy("item", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("wpa"), 6).alias("impact")), f"with {_W} select item, side, count(*) as n, round(sum(wpa), 6)::double as impact from w group by 1, 2", "e")
add("e18_cluster_profile", lambda s, d: table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("vec_id") % 2).cast("double")).alias("rate"), F.count_distinct(F.col("vec_id") % 7).alias("classes")),
    "select label, count(*) as n, avg((vec_id % 2)::double) as rate, count(distinct vec_id % 7) as classes from embeddings group by 1")
