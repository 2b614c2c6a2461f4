"""Queries of composite, feature and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import outcomes as O
from ..operators import sequences as S
from ..sources.views import events, matches, rosters, table
from .core import _BASKETS, _RULES_SQL, RULES, SUMS
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add


def nemesis(m: DataFrame, b: DataFrame) -> DataFrame:
    """Per category of own basket: record against the most frequent opponent of each entity."""
    top = O.top_k(m.groupBy("entity", "opponent").agg(F.count_if(F.expr("result = 'loss'")).alias("lost")), ["entity"], [F.desc("lost"), F.col("opponent")], 1).select("entity", "opponent")
    return O.win_rate(m.join(top, ["entity", "opponent"]).join(b, "match_id").withColumn("label", X.classify_basket(F.col("items"), RULES)), ["label"])


add("e10_nemesis", lambda s, d: nemesis(matches(s, d), O.baskets(rosters(s, d))),
    f"""with {_BASKETS}, l as (select entity, opponent, count(*) filter (result = 'loss') as lost from m group by 1, 2), t as (select entity, opponent from l qualify row_number() over (partition by entity order by lost desc, opponent) = 1)
select {_RULES_SQL} as label, {SUMS}, count(*) filter (result = 'win') / count(*) as win_rate from m join t using (entity, opponent) join b using (match_id) group by 1""", "mr")


def stratified_gap(df: DataFrame, strata: int, value: str, arm, y, least: int) -> DataFrame:
    """Mean of y in both arms within equal-width strata of a value, where each has at least `least` rows."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    cut = F.least(F.floor((F.col(value) - F.col("low")) * strata / (F.col("high") - F.col("low"))), F.lit(strata - 1)).cast("int")
    g = df.join(F.broadcast(ends)).withColumn("stratum", cut).groupBy("stratum").agg(F.count_if(arm).alias("n1"), F.count_if(~arm).alias("n0"), F.avg(F.when(arm, y)).alias("mean1"), F.avg(F.when(~arm, y)).alias("mean0"))
    return g.where((F.col("n1") >= least) & (F.col("n0") >= least)).withColumn("gap", F.col("mean1") - F.col("mean0"))


add("e16_stratified_gap", lambda s, d: stratified_gap(matches(s, d), 10, "own_rating", F.col("kind") == "5-LOW", O.is_("win").cast("double"), 5),
    """with x as (select *, (result = 'win')::int::double as y, kind = '5-LOW' as arm from m), z as (select min(own_rating) as lo, max(own_rating) as hi from x)
select least(floor((own_rating - lo) * 10 / (hi - lo)), 9)::int as stratum, count(*) filter (arm) as n1, count(*) filter (not arm) as n0, avg(y) filter (arm) as mean1, avg(y) filter (not arm) as mean0, avg(y) filter (arm) - avg(y) filter (not arm) as gap
from x, z group by 1 having count(*) filter (arm) >= 5 and count(*) filter (not arm) >= 5""", "m")


def basket_fit(b: DataFrame, pool: list[str]) -> DataFrame:
    """Frequent baskets with how many items a pool owns and which are missing."""
    own = F.array(*map(F.lit, pool))
    g = b.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.array_join("items", "|").alias("basket"), "n", F.size(F.array_intersect("items", own)).alias("owned"), F.array_join(F.array_except("items", own), "|").alias("missing"))


add("e17_basket_fit", lambda s, d: basket_fit(O.baskets(rosters(s, d)), ["Brand#11", "Brand#12", "Brand#13", "Brand#14"]),
    f"""with {_BASKETS}, g as (select items, count(*) as n from b group by items) select array_to_string(items, '|') as basket, n, len(list_intersect(items, ['Brand#11', 'Brand#12', 'Brand#13', 'Brand#14'])) as owned,
coalesce(array_to_string(list_filter(items, lambda i: i not in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14')), '|'), '') as missing from g""", "r")

_P = "p as (select match_id, event_id, tick, item, side, (k + 1) / 102 as p from e), w as (select *, p - coalesce(lag(p) over (partition by match_id order by tick, event_id), 0.5) as wpa from p)"
_delta = lambda s, d: events(s, d).withColumn("p", (F.col("k") + 1) / 102).withColumn("wpa", F.col("p") - F.coalesce(F.lag("p").over(Window.partitionBy("match_id").orderBy("tick", "event_id")), F.lit(0.5)))


def impact_counts(w: DataFrame) -> DataFrame:
    """How often an item was a match's best, worst and most critical, and the difference of the first two."""
    at = lambda c: F.struct(c, "event_id")
    g = w.groupBy("match_id").agg(F.max_by("item", at("wpa")).alias("carry"), F.min_by("item", at("wpa")).alias("liability"), F.max_by("item", at("abs_wpa")).alias("critical"))
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("item")) for c in ("carry", "liability", "critical")))).alias("x")
    out = g.select(kinds).groupBy("x.item").pivot("x.kind", ["carry", "liability", "critical"]).agg(F.count(F.lit(1))).fillna(0)
    return out.withColumn("net", F.col("carry") - F.col("liability"))


add("e20_impact_counts", lambda s, d: impact_counts(_delta(s, d).withColumn("abs_wpa", F.abs("wpa"))),
    f"""with {_P}, g as (select match_id, arg_max(item, (wpa, event_id)) as carry, arg_min(item, (wpa, event_id)) as liability, arg_max(item, (abs(wpa), event_id)) as critical from w group by 1),
u as (select 'carry' as kind, carry as item from g union all select 'liability', liability from g union all select 'critical', critical from g)
select item, count(*) filter (kind = 'carry') as carry, count(*) filter (kind = 'liability') as liability, count(*) filter (kind = 'critical') as critical, count(*) filter (kind = 'carry') - count(*) filter (kind = 'liability') as net from u group by item""", "e")
add("e22_impact_by_category", lambda s, d: _delta(s, d).groupBy((F.col("match_id") % 5).alias("category"), "item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wpa"), 6).alias("impact")),
    f"with {_P} select match_id % 5 as category, item, count(*) as n, round(avg(wpa), 6)::double as impact from w group by 1, 2", "e")
add("f10_match_features", lambda s, d: (lambda r, e: r.join(e, "match_id", "full_outer"))(
    rosters(s, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("cost"), 6).alias("mean_cost"), F.count_if(F.col("is_player") == 1).alias("own_items")),
    events(s, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("plays"), F.count_if(X.lane("x") == "left").alias("left_plays"), F.max("tick").alias("duration"))),
    """with a as (select match_id, count(*) as items, round(avg(cost), 6) as mean_cost, count(*) filter (is_player = 1) as own_items from r group by 1),
b as (select match_id, count(*) as plays, count(*) filter (x < 7500) as left_plays, max(tick) as duration from e group by 1) select * from a full join b using (match_id)""", "re")


def padded_sequences(e: DataFrame, length: int) -> DataFrame:
    """(match_id, n, text) of each match's first `length` events in order as one array a match, the rest counted; padding is left to the reader."""
    z = F.array_sort(F.collect_list(F.struct("tick", "event_id", F.concat_ws(":", "side", "item", "cost").alias("f"))))
    g = e.groupBy("match_id").agg(z.alias("z"))
    return g.select("match_id", F.size("z").cast("long").alias("n"), F.array_join(F.transform(F.slice("z", 1, length), lambda x: x["f"]), "|").alias("sequence"))


add("f9_sequences", lambda s, d: padded_sequences(events(s, d), 64),
    "select match_id, count(*) as n, string_agg(f, '|' order by tick, event_id) filter (i <= 64) as sequence from (select *, side || ':' || item || ':' || cost as f, row_number() over (partition by match_id order by tick, event_id) as i from e) group by 1", "e")


def rarity(r: DataFrame) -> DataFrame:
    """Distance of a basket's shape (size, mean cost) from the mean, in standard deviations."""
    g = r.groupBy("match_id").agg(F.count(F.lit(1)).cast("double").alias("size"), F.avg("cost").alias("cost"))
    ends = g.agg(*(f(c).alias(f"{n}_{c}") for c in ("size", "cost") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    z = lambda c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")
    return g.join(F.broadcast(ends)).select("match_id", F.round(F.sqrt(z("size") * z("size") + z("cost") * z("cost")), 6).alias("rarity"))


add("f15_rarity", lambda s, d: rarity(rosters(s, d)),
    "with g as (select match_id, count(*)::double as size, avg(cost) as cost from r group by 1), z as (select avg(size) as a, stddev_pop(size) as b, avg(cost) as c, stddev_pop(cost) as f from g) select match_id, round(sqrt(pow((size - a) / b, 2) + pow((cost - c) / f, 2)), 6) as rarity from g, z", "r")
add("f16_select_training", lambda s, d: matches(s, d).join(rosters(s, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 3"), "match_id").orderBy(F.desc("ts"), F.desc("match_id")).limit(200).select("match_id", "k"),
    "select match_id, k from m join (select match_id, count(*) as k from r group by 1 having count(*) >= 3) using (match_id) order by ts desc, match_id desc limit 200", "mr")


def resource_at_events(e: DataFrame) -> DataFrame:
    """Spent by both sides up to and with each event, and the difference from the own side's view."""
    w = Window.partitionBy("match_id").orderBy("tick", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("cost")).otherwise(0)).over(w)
    return e.select("event_id", of("team").alias("own"), of("opponent").alias("other")).withColumn("differential", F.col("other") - F.col("own"))


_SPENT = "select event_id, tick, match_id, sum(case when side = 'team' then cost else 0 end) over w::bigint as own, sum(case when side = 'opponent' then cost else 0 end) over w::bigint as other from e window w as (partition by match_id order by tick, event_id rows unbounded preceding)"
add("c14_running_spend", lambda s, d: resource_at_events(events(s, d)), f"select event_id, own, other, other - own as differential from ({_SPENT})".replace(" over w::bigint", " over w"), "e")
add("c15_spend_differential", lambda s, d: resource_at_events(events(s, d)).join(events(s, d).select("event_id", "match_id", F.floor(F.col("tick") / 500).alias("step")), "event_id").groupBy("step").agg(F.avg("differential").alias("mean"), F.count_distinct("match_id").alias("n")).where("n >= 2"),
    f"select tick // 500 as step, avg(other - own) as mean, count(distinct match_id) as n from ({_SPENT}) group by 1 having count(distinct match_id) >= 2".replace(" over w::bigint", " over w"), "e")
add("c12_plays_per_step", lambda s, d: S.active_curve(events(s, d), 0, 500).groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("steps"), F.max("alive").alias("most")),
    "select match_id, side, count(*) as steps, max(n) as most from (select match_id, side, tick // 500 as k, count(*) as n from e group by all) group by 1, 2", "e")
_AB = "x as (select event_id, match_id, tick, match_id % 2 as won, (k + 1) / 102 as pa, (k % 50 + 1) / 52 as pb from e)"
add("j11_ab_eval", lambda s, d: events(s, d).select("match_id", "tick", (F.col("match_id") % 2).alias("won"), F.explode(F.array(F.struct(F.lit("a").alias("model"), ((F.col("k") + 1) / 102).alias("p")), F.struct(F.lit("b").alias("model"), ((F.col("k") % 50 + 1) / 52).alias("p")))).alias("z")).groupBy("z.model").agg(
    F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.when(F.col("won") == 1, F.log("z.p")).otherwise(F.log(1 - F.col("z.p")))), 6).alias("loss"), F.avg(F.when((F.col("z.p") >= 0.5) == (F.col("won") == 1), 1.0).otherwise(0.0)).alias("accuracy")),
    f"with {_AB}, z as (select 'a' as model, won, pa as p from x union all select 'b', won, pb from x) select model, count(*) as n, round(avg(-case when won = 1 then ln(p) else ln(1 - p) end), 6) as loss, avg(((p >= 0.5) = (won = 1))::int::double) as accuracy from z group by 1", "e")
add("j22_select_cohort", lambda s, d: (lambda c: c.join(matches(s, d).groupBy("entity").agg(F.count_distinct("kind").alias("kinds")).where("kinds >= 4"), "entity", "left_semi"))(matches(s, d).groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")),
    "select entity, kind, count(*) as n from m where entity in (select entity from m group by 1 having count(distinct kind) >= 4) group by 1, 2 having count(*) >= 2", "m")


def participation_ratio(v: DataFrame) -> DataFrame:
    """Squared trace of the covariance over its squared norm, from sums per pair of dimensions that each task pre-aggregates."""
    pairs = v.select(F.posexplode("embedding").alias("i", "x"), "embedding").select("i", F.col("x").cast("double").alias("x"), F.posexplode("embedding").alias("j", "y"))
    cov = pairs.groupBy("i", "j").agg(F.covar_pop("x", F.col("y").cast("double")).alias("c"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    return cov.agg(F.round(trace * trace / F.sum(F.col("c") * F.col("c")), 3).alias("ratio"))


add("j21_participation_ratio", lambda s, d: participation_ratio(table(s, d, "embeddings")),
    """with a as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
c as (select a.i as i, b.i as j, covar_pop(a.x, b.x) as c from a join a b using (vec_id) group by 1, 2)
select round(pow(sum(c) filter (i = j), 2) / sum(c * c), 3) as ratio from c""")


def distant_subset(e: DataFrame, least: int) -> DataFrame:
    """Per match the events, in order, that lie at least `least` ticks from all kept before; a fold over the match's own sorted array."""
    ticks = F.array_sort(F.collect_list("tick"))
    keep = F.aggregate(ticks, F.array().cast("array<int>"), lambda acc, x: F.when(F.forall(acc, lambda y: F.abs(x - y) >= least), F.concat(acc, F.array(x))).otherwise(acc))
    return e.groupBy("match_id").agg(keep.alias("kept")).select("match_id", F.size("kept").alias("n"), F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


add("j20_distant_subset", lambda s, d: distant_subset(events(s, d), 500))
