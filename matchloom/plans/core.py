"""Queries of the scalar, outcome, ordered and binning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import outcomes as O
from ..sources.views import events, matches, rosters, table
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

SUMS = "count(*) as n, count(*) filter (result = 'win')::bigint as wins, count(*) filter (result = 'loss')::bigint as losses, count(*) filter (result = 'draw')::bigint as draws"

# --- A: scans, keys, dedup, links -------------------------------------------------------------------------------

add("a1_scope", lambda s, d: O.scope(matches(s, d), "BUILDING", ["1-URGENT", "2-HIGH"], 5000).select("match_id", "kind", "own_rating"),
    "select match_id, kind, own_rating from m where corpus = 'BUILDING' and kind in ('1-URGENT', '2-HIGH') and own_rating >= 5000", "m")
add("a4_match_id", lambda s, d: matches(s, d).select("match_id", X.match_id("match_id", "entity", "opponent").alias("id")),
    """select match_id, substr(sha256(match_id || '", "' || entity || '", "' || opponent), 1, 32) as id from m""", "m")
add("a5_basket_hash", lambda s, d: O.baskets(rosters(s, d)).select("match_id", X.basket_hash(F.col("items")).alias("hash")),
    "select match_id, substr(md5(string_agg(distinct item, '|' order by item)), 1, 16) as hash from r where is_player = 1 group by match_id", "r")


def append_new(target, batch, key):
    """Rows of the batch whose key the target lacks, once each (the smallest row)."""
    first = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("row")).select(key, "row.*")
    return first.join(target.select(key), key, "left_anti")


def _append(s, d):
    m = matches(s, d).select("match_id", "kind", "result")
    return append_new(m.where("match_id % 3 = 0"), m.union(m), "match_id")


add("a6_append_new", _append, "select match_id, kind, result from m where match_id % 3 != 0", "m")
add("a9_extract_links", lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href")),
    """select page_id, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as href from (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as l from pages)""")
add("a10_query_string", lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", r"[?&]page=([^&#]*)", 1).alias("page"), F.regexp_extract("url", r"[?&]utm_source=([^&#]*)", 1).alias("utm_source")),
    "select page_id, coalesce(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, coalesce(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') as utm_source from pages")
add("a12_parse_number", lambda s, d: table(s, d, "pages").select("page_id", X.parse_number(F.regexp_extract("url", "/([0-9]+)", 1)).alias("value")),
    "select page_id, try_cast(regexp_replace(regexp_extract(url, '/([0-9]+)', 1), '[^0-9.-]', '', 'g') as double) as value from pages")


def match_links(links, m):
    """Link records joined to the first match that has their four keys; unmatched ones keep a null id."""
    keys = ["entity", "opponent", "own_score", "opp_score"]
    return links.join(m.groupBy(*keys).agg(F.min("match_id").alias("match_id")), keys, "left")


add("a11_match_links", lambda s, d: match_links(matches(s, d).select((F.col("match_id") + 1).alias("link_id"), "entity", "opponent", "own_score", F.lit(1).cast("long").alias("opp_score")), matches(s, d)),
    """with k as (select entity, opponent, own_score, opp_score, min(match_id) as match_id from m group by all)
select l.entity, l.opponent, l.own_score, l.opp_score, l.link_id, k.match_id from (select match_id + 1 as link_id, entity, opponent, own_score, 1::bigint as opp_score from m) l
left join k using (entity, opponent, own_score, opp_score)""", "m")


def merge_metrics(batches, counters):
    """Counters add up over batches, gauges keep their last value: batches(name, label, value, at)."""
    g = batches.groupBy("name", "label").agg(F.sum("value").alias("total"), F.max_by("value", "at").alias("last"))
    return g.select("name", "label", F.when(F.col("name").isin(*counters), F.col("total")).otherwise(F.col("last")).alias("value"))


add("a18_merge_metrics", lambda s, d: merge_metrics(events(s, d).select(F.col("item").alias("name"), F.col("match_id").alias("label"), F.col("k").cast("long").alias("value"), F.struct("ts", "event_id").alias("at")), ["click", "view"]),
    "select item as name, match_id as label, case when item in ('click', 'view') then sum(k)::bigint else arg_max(k, (ts, event_id))::bigint end as value from e group by item, match_id", "e")


def histogram(df, value, edges, by):
    """Cumulative counts at or below each edge, as latency histograms keep them."""
    bucket = F.explode(F.array(*map(F.lit, edges))).alias("edge")
    return df.select(*by, F.col(value).alias("_v"), bucket).groupBy(*by, "edge").agg(F.count_if(F.col("_v") <= F.col("edge")).alias("n"))


add("a19_histogram", lambda s, d: histogram(events(s, d), "k", [10, 25, 50, 75, 100], ["item"]),
    "select item, edge, count(*) filter (k <= edge) as n from e, (select unnest([10, 25, 50, 75, 100]) as edge) group by item, edge", "e")
add("a20_batch_yield", lambda s, d: (lambda g: g.withColumn("outcome", F.when(F.col("zero_share") == 0, "success").when(F.col("zero_share") == 1, "failed").otherwise("partial")))(
    matches(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("result = 'win'")).alias("new"), F.avg(F.when(F.col("result") == "win", 0.0).otherwise(1.0)).alias("zero_share"),
                                        F.round(F.percentile("own_rating", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("own_rating", F.lit(0.9)), 4).alias("p90"))),
    """select entity, count(*) as n, count(*) filter (result = 'win') as new, avg(case when result = 'win' then 0.0 else 1.0 end) as zero_share,
round(quantile_cont(own_rating, 0.5), 4) as p50, round(quantile_cont(own_rating, 0.9), 4) as p90,
case avg(case when result = 'win' then 0.0 else 1.0 end) when 0 then 'success' when 1 then 'failed' else 'partial' end as outcome from m group by entity""", "m")

# --- B: expressions ---------------------------------------------------------------------------------------------

add("b1_normalize_tag", lambda s, d: matches(s, d).select("match_id", X.normalize_tag("kind").alias("tag")), "select match_id, '#' || upper(trim(kind)) as tag from m", "m")
add("b2_variant", lambda s, d: rosters(s, d).select("match_id", "item", "cost", X.variant(F.col("cost") % 4).alias("form")).distinct(),
    "select distinct match_id, item, cost, case when cost % 4 >= 2 then 'hero' when cost % 4 = 1 then 'evo' else 'base' end as form from r", "r")
RULES = [("alpha", ["Brand#11", "Brand#12"], 1), ("beta", ["Brand#21", "Brand#22", "Brand#23", "Brand#24"], 2), ("gamma", ["Brand#31", "Brand#32", "Brand#33"], 1)]
_RULES_SQL = """case when len(list_intersect(items, ['Brand#11', 'Brand#12'])) >= 1 then 'alpha' when len(list_intersect(items, ['Brand#21', 'Brand#22', 'Brand#23', 'Brand#24'])) >= 2 then 'beta'
when len(list_intersect(items, ['Brand#31', 'Brand#32', 'Brand#33'])) >= 1 then 'gamma' else 'other' end"""
_BASKETS = "b as (select match_id, list(distinct item order by item) as items from r where is_player = 1 group by match_id)"
add("b3_classify_basket", lambda s, d: O.baskets(rosters(s, d)).select("match_id", X.classify_basket(F.col("items"), RULES).alias("label")), f"with {_BASKETS} select match_id, {_RULES_SQL} as label from b", "r")


def match_label(df, text, labels, label):
    """For each text the label that equals it, or else the shortest that it contains, ignoring case; labels are few by meaning."""
    t, l = F.lower(F.col(text)), F.lower(F.col(label))
    rank = F.struct(F.when(t == l, 0).otherwise(1), F.length(label), F.col(label))
    return df.join(F.broadcast(labels), t.contains(l)).groupBy(text).agg(F.min_by(label, rank).alias("label"))


add("b4_match_label", lambda s, d: match_label(table(s, d, "part").select("p_type").distinct(), "p_type", table(s, d, "part").select(F.substring("p_type", 1, 4).alias("label")).distinct(), "label"),
    "select p_type, arg_min(label, (case when lower(p_type) = lower(label) then 0 else 1 end, length(label), label)) as label from (select distinct p_type from part), (select distinct substr(p_type, 1, 4) as label from part) where contains(lower(p_type), lower(label)) group by p_type")
add("b5_names", lambda s, d: matches(s, d).select("kind", X.slug("kind").alias("slug"), X.alnum_key("kind").alias("key")).distinct(),
    "select distinct kind, regexp_replace(lower(kind), '[^a-z0-9]+', '-', 'g') as slug, regexp_replace(lower(kind), '[^a-z0-9]', '', 'g') as key from m", "m")
add("b6_item_type", lambda s, d: rosters(s, d).join(F.broadcast(s.createDataFrame([("STANDARD", "troop"), ("SMALL", "spell")], "item_type string, type string")), "item_type", "left")
    .select("match_id", "item", "item_type", F.coalesce("type", F.lit("building")).alias("type")).distinct(),
    "select distinct match_id, item, item_type, case item_type when 'STANDARD' then 'troop' when 'SMALL' then 'spell' else 'building' end as type from r", "r")
add("b7_displayed_level", lambda s, d: rosters(s, d).select("match_id", "item", X.displayed_level("cost", F.col("cost") % 3 + 9, 15).alias("level")).distinct(), "select distinct match_id, item, cost + (15 - (cost % 3 + 9)) as level from r", "r")
_PHASE = "case when tick >= 7920 then 'late' when tick >= 5280 then 'overtime' when tick >= 3360 then 'double' else 'single' end"
_LANE = "case when x < 7500 then 'left' when x > 10500 then 'right' else 'center' end"
add("b8_phase", lambda s, d: events(s, d).select("event_id", X.phase("tick").alias("phase")), f"select event_id, {_PHASE} as phase from e", "e")
add("b9_lane", lambda s, d: events(s, d).select("event_id", X.lane("x").alias("lane")), f"select event_id, {_LANE} as lane from e", "e")
add("b10_one_hot", lambda s, d: events(s, d).select("event_id", *X.one_hot("item", ["click", "view", "error"])),
    "select event_id, (item = 'click')::int as is_click, (item = 'view')::int as is_view, (item = 'error')::int as is_error from e", "e")
add("b11_cyclical", lambda s, d: events(s, d).select("event_id", *((F.round(c, 6) + 0.0).alias(n) for c, n in zip(X.cyclical(F.hour("ts"), 24), ("sin_h", "cos_h")))),
    "select event_id, round(sin(hour(ts) * (2 * pi() / 24)), 6) + 0.0 as sin_h, round(cos(hour(ts) * (2 * pi() / 24)), 6) + 0.0 as cos_h from e", "e")
SCHEDULE = [(0.0, 3360.0, 0.25), (3360.0, 5280.0, 0.5), (5280.0, 1e9, 0.75)]
add("b12_regenerated", lambda s, d: events(s, d).select("event_id", X.regenerated(F.col("tick") - 600, F.col("tick"), SCHEDULE).alias("regen")),
    "select event_id, greatest(0, least(tick, 3360.0) - greatest(tick - 600, 0.0)) * 0.25::double + greatest(0, least(tick, 5280.0) - greatest(tick - 600, 3360.0)) * 0.5::double + greatest(0, least(tick, 1e9) - greatest(tick - 600, 5280.0)) * 0.75::double as regen from e", "e")
add("b13_platt", lambda s, d: events(s, d).select("event_id", F.round(X.platt(X.to_logit(F.col("k") / 100), -0.9, 0.1), 6).alias("p")),
    "select event_id, round(1 / (1 + exp(-0.9 * ln(c / (1 - c)) + 0.1)), 6) as p from (select event_id, least(greatest(k / 100, 1e-6), 1 - 1e-6) as c from e)", "e")
add("b16_basket_distance", lambda s, d: O.baskets(rosters(s, d), 1).withColumnRenamed("items", "a").join(O.baskets(rosters(s, d), 0).withColumnRenamed("items", "b"), "match_id", "left").select("match_id", X.basket_distance(F.col("a"), F.col("b")).alias("distance")),
    f"with {_BASKETS}, b0 as (select match_id, list(distinct item) as items from r where is_player = 0 group by match_id) select b.match_id, case when b0.items is not null then 8 - len(list_intersect(b.items, b0.items)) end as distance from b left join b0 using (match_id)", "r")

# --- E: aggregates -----------------------------------------------------------------------------------------------

add("e1_overview", lambda s, d: O.overview(matches(s, d)), f"select {SUMS}, sum(own_score)::bigint as score_for, sum(opp_score)::bigint as score_against, avg(own_score) as avg_for, min(ts) as first_ts, max(ts) as last_ts from m", "m")
add("e2_win_rate_by_category", lambda s, d: O.win_rate(matches(s, d), ["kind"]), f"select kind, {SUMS}, count(*) filter (result = 'win') / count(*) as win_rate from m group by kind", "m")
add("e2_decided_win_rate", lambda s, d: O.win_rate(matches(s, d), ["corpus", "kind"], "decided"),
    f"select corpus, kind, {SUMS}, count(*) filter (result = 'win') / nullif(count(*) filter (result != 'draw'), 0) as win_rate from m group by corpus, kind", "m")
add("e3_basket_stats", lambda s, d: O.basket_stats(matches(s, d), O.baskets(rosters(s, d)), 2),
    f"with {_BASKETS} select array_to_string(items, '|') as basket, {SUMS}, count(*) filter (result = 'win') / count(*) as win_rate, min(match_id) as example from m join b using (match_id) group by items having count(*) >= 2", "mr")
add("e4_crosstab", lambda s, d: O.crosstab(matches(s, d), "result", "own_score"), "select result, own_score, count(*) as n from m group by all", "m")
add("e5_item_matchups", lambda s, d: O.item_matchups(matches(s, d), rosters(s, d), 5),
    f"select item, {SUMS}, count(*) filter (result = 'win') / count(*) as win_rate from m join (select distinct match_id, item from r where is_player = 0) using (match_id) group by item having count(*) >= 5", "mr")
add("e6_by_hour", lambda s, d: events(s, d).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("match_id") % 2).cast("double")).alias("rate")),
    "select hour(ts)::int as hour, count(*) as n, avg((match_id % 2)::double) as rate from e group by 1", "e")
add("e7_traffic_index", lambda s, d: O.traffic_index(events(s, d).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))),
    "with h as (select hour(ts)::int as hour, count(*) as n from e group by 1) select hour, n, case when max(n) over () > min(n) over () then 100.0::double * (n - min(n) over ()) / (max(n) over () - min(n) over ()) else 0 end as traffic from h", "e")
add("e8_category_stats", lambda s, d: O.win_rate(matches(s, d).join(O.baskets(rosters(s, d)), "match_id").withColumn("label", X.classify_basket(F.col("items"), RULES)), ["label"]),
    f"with {_BASKETS} select {_RULES_SQL} as label, {SUMS}, count(*) filter (result = 'win') / count(*) as win_rate from m join b using (match_id) group by 1", "mr")
add("e9_top_opponents", lambda s, d: O.top_opponents(matches(s, d), 3),
    f"""with g as (select entity, opponent, {SUMS}, arg_max(kind, (ts, match_id)) as last_kind from m group by entity, opponent having count(*) >= 2)
select entity, opponent, n, wins, losses, draws, last_kind, rank, wins / nullif(wins + losses, 0) as win_rate from (select *, row_number() over (partition by entity order by n desc, opponent)::int as rank from g) where rank <= 3""", "m")
add("e11_corpus_stats", lambda s, d: matches(s, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.count_if(F.expr("result = 'win'")).alias("wins"), (100.0 * F.count_if(F.expr("own_rating > 5000")) / F.count(F.lit(1))).alias("coverage")),
    "select corpus, count(*) as n, count(distinct entity) as entities, count(*) filter (result = 'win') as wins, 100.0::double * count(*) filter (own_rating > 5000) / count(*) as coverage from m group by corpus", "m")
add("e12_mode_report", lambda s, d: O.win_rate(matches(s, d).where("kind = '5-LOW'"), ["entity"]).join(O.current_run(matches(s, d).where("kind = '5-LOW'"), ["entity"]), "entity"),
    f"""with k as (select * from m where kind = '5-LOW'), w as (select entity, {SUMS}, count(*) filter (result = 'win') / count(*) as win_rate from k group by entity),
o as (select entity, result, row_number() over (partition by entity order by ts desc, match_id desc) as i, first_value(result) over (partition by entity order by ts desc, match_id desc) as head from k),
q as (select entity, any_value(head) as result, coalesce(min(i) filter (result != head) - 1, max(i)) as run from o group by entity) select w.*, q.result, q.run from w join q using (entity)""", "m")
add("e13_cross_reference", lambda s, d: O.observations(matches(s, d)).groupBy("entity").agg(F.max(F.when(F.col("role") == "player", F.col("rating"))).alias("as_player"), F.max(F.when(F.col("role") == "opponent", F.col("rating"))).alias("as_opponent"), F.count(F.lit(1)).alias("n")),
    "select entity, max(r) filter (role = 1) as as_player, max(r) filter (role = 2) as as_opponent, count(*) as n from (select entity, own_rating as r, 1 as role from m union all select opponent, opp_rating, 2 from m) group by entity", "m")
add("e14_observations", lambda s, d: O.observations(matches(s, d)).drop("ts"),
    "select entity, own_rating as rating, 'player' as role, match_id, result from m union all select opponent, opp_rating, 'opponent', match_id, case result when 'win' then 'loss' when 'loss' then 'win' else 'draw' end from m", "m")
add("e15_band_levels", lambda s, d: matches(s, d).groupBy(X.width_bucket("own_rating", 0, 25000, 10).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.expr("avg(own_score) filter (where result = 'win')").alias("avg_win")).where("n >= 20"),
    "select case when own_rating < 0 then 0 when own_rating >= 25000 then 11 else floor(own_rating * 10 / 25000)::int + 1 end as band, count(*) as n, avg(own_score) filter (result = 'win') as avg_win from m group by 1 having count(*) >= 20", "m")
add("e24_vocabulary", lambda s, d: (lambda v: v.withColumn("index", (F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("item")) + 1)))(rosters(s, d).groupBy("item").agg(F.max("cost").alias("cost"))),
    "select item, max(cost) as cost, (row_number() over (order by item) + 1)::int as index from r group by item", "r")

# --- H: bins ------------------------------------------------------------------------------------------------------

add("h1_width_bucket", lambda s, d: matches(s, d).groupBy(X.width_bucket("opp_rating", -500, 9500, 20).alias("bin")).agg(F.count(F.lit(1)).alias("n")),
    "select case when opp_rating < -500 then 0 when opp_rating >= 9500 then 21 else floor((opp_rating + 500) * 20 / 10000)::int + 1 end as bin, count(*) as n from m group by 1", "m")
add("h2_edge_bucket", lambda s, d: matches(s, d).groupBy(X.edge_bucket("own_rating", [1000, 4000, 9000, 16000]).alias("bin")).agg(F.count(F.lit(1)).alias("n")),
    "select ((own_rating >= 1000)::int + (own_rating >= 4000)::int + (own_rating >= 9000)::int + (own_rating >= 16000)::int) as bin, count(*) as n from m group by 1", "m")


def quantile_bucket(df, value, n):
    """Bin of each row by the column's own quantiles; equal values share a bin."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("edges"))
    return df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(value) > e))).drop("edges")


add("h3_quantile_bucket", lambda s, d: quantile_bucket(matches(s, d), "own_rating", 4).groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
    "with q as (select quantile_cont(own_rating, [0.25, 0.5, 0.75]) as e from m) select ((own_rating > e[1])::int + (own_rating > e[2])::int + (own_rating > e[3])::int) as bin, count(*) as n from m, q group by 1", "m")

# --- I: ordered ---------------------------------------------------------------------------------------------------

_RUNS = """d as (select *, case when result = lag(result) over w then 0 else 1 end as fresh from m where result != 'draw' window w as (partition by entity order by ts, match_id)),
k as (select *, sum(fresh) over (partition by entity order by ts, match_id)::bigint as run from d),
s as (select entity, run, any_value(result) as result, count(*) as length, arg_min(match_id, (ts, match_id)) as first_match, arg_max(match_id, (ts, match_id)) as last_match,
arg_min(own_rating, (ts, match_id)) as start_rating, arg_max(own_rating, (ts, match_id)) as end_rating from k group by entity, run)"""
add("i1_streaks", lambda s, d: O.streaks(matches(s, d), ["entity"]), f"with {_RUNS} select * from s", "m")
add("i2_streak_summary", lambda s, d: O.streak_summary(O.streaks(matches(s, d), ["entity"]), ["entity"]),
    f"with {_RUNS} select entity, arg_max(result, run) as current, arg_max(length, run) as current_length, max(length) filter (result = 'win') as longest_win, arg_max(first_match, (length, -run)) filter (result = 'win') as longest_win_first, max(length) filter (result = 'loss') as longest_loss from s group by entity", "m")
add("i3_current_run", lambda s, d: O.current_run(matches(s, d), ["entity"]),
    """with o as (select entity, result, row_number() over w as i, first_value(result) over w as head from m window w as (partition by entity order by ts desc, match_id desc))
select entity, any_value(head) as result, coalesce(min(i) filter (result != head) - 1, max(i)) as run from o group by entity""", "m")
add("i4_last_n", lambda s, d: O.last_n_stats(matches(s, d), ["entity"], 10),
    f"select entity, {SUMS}, sum(change)::bigint as change, avg(own_score) as avg_score from (select *, row_number() over (partition by entity order by ts desc, match_id desc) as i from m) where i <= 10 group by entity", "m")
add("i4_rolling", lambda s, d: O.rolling(matches(s, d), ["entity"], 5),
    "select entity, match_id, avg((result = 'win')::int) over w as rate, count(*) over w as n from m window w as (partition by entity order by ts, match_id rows between 4 preceding and current row)", "m")
add("i5_rating_history", lambda s, d: O.rating_history(matches(s, d), ["entity"]),
    "select entity, match_id, own_rating + change as after, sum(change) over (partition by entity order by ts, match_id rows unbounded preceding)::bigint as running_change from m", "m")
add("i6_downsample", lambda s, d: O.downsample(matches(s, d), ["entity"], 4),
    "select entity, match_id, i::int as i from (select entity, match_id, row_number() over (partition by entity order by ts, match_id) as i, count(*) over (partition by entity) as z from m) where (i - 1) % ceil(z / 4)::bigint = 0 or i = z", "m")
add("i7_recent", lambda s, d: matches(s, d).orderBy(F.desc("ts"), F.desc("match_id")).limit(50).select("match_id", "entity", "result", "change"),
    "select match_id, entity, result, change from m order by ts desc, match_id desc limit 50", "m")
add("i8_top_k", lambda s, d: O.top_k(rosters(s, d).groupBy("is_player", "item").agg(F.count(F.lit(1)).alias("n")), ["is_player"], [F.desc("n"), F.col("item")], 5),
    "select is_player, item, n, rank::int as rank from (select is_player, item, count(*) as n, row_number() over (partition by is_player order by count(*) desc, item) as rank from r group by is_player, item) where rank <= 5", "r")
add("i13_union_all", lambda s, d: (lambda m: m.where("result = 'draw'").union(m.where("result = 'win'").orderBy(F.desc("ts"), "match_id").limit(100)))(matches(s, d).select("match_id", "result", "ts")).drop("ts"),
    "select match_id, result from m where result = 'draw' union all (select match_id, result from m where result = 'win' order by ts desc, match_id limit 100)", "m")
add("i14_key_sets", lambda s, d: (lambda a, b: a.subtract(b).withColumn("op", F.lit("minus")).union(a.intersect(b).withColumn("op", F.lit("and"))))(matches(s, d).where("result = 'win'").select("entity"), matches(s, d).where("result = 'draw'").select("entity")),
    "select entity, 'minus' as op from (select entity from m where result = 'win' except select entity from m where result = 'draw') union all select entity, 'and' from (select entity from m where result = 'win' intersect select entity from m where result = 'draw')", "m")
add("i15_distinct", lambda s, d: matches(s, d).select("entity", "kind").distinct(), "select distinct entity, kind from m", "m")
add("d9_latest_by", lambda s, d: O.latest_by(matches(s, d).select("entity", "ts", "match_id", "kind", "own_rating"), ["entity"], ["ts", "match_id"]).drop("ts"),
    "select entity, match_id, kind, own_rating from (select *, row_number() over (partition by entity order by ts desc, match_id desc) as i from m) where i = 1", "m")
add("i16_page", lambda s, d: O.page(matches(s, d).select("match_id", "kind"), [F.col("match_id")], 2, 25), "select match_id, kind, (select count(*) from m) as total, (select count(*) from m) > 75 as has_more from m order by match_id limit 25 offset 50", "m")
add("i17_vocabulary_distinct", lambda s, d: rosters(s, d).select("item").distinct(), "select distinct item from r", "r")
add("j31_time_split", lambda s, d: O.time_split(matches(s, d).select("match_id", "own_rating"), "own_rating", 0.2), "select match_id, own_rating, own_rating > (select quantile_cont(own_rating, 0.8) from m) as validation from m", "m")
