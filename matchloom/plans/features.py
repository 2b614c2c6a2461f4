"""Queries of event features and padded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import deep_dive as D9
from ..operators import event_features as X9
from ..operators import pilots as PF
from ..sources.views import E_SQL, M_SQL, events, matches
from .register import Registry
from .resources import _grown, _states
from .sequence import _ORIENT, ZONES

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

SPELL, LENGTH = "purchase", 48


def item_type() -> Column:
    item = F.col("item")
    return F.when(item.isin("click", "view"), "troop").when(item == "purchase", "spell").when(item == "error", "building")


def zone_value() -> Column:
    """The weight of the first zone that holds the place."""
    out = F.lit(None).cast("double")
    for _, x0, y0, x1, y1, weight in reversed(ZONES):
        out = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), weight).otherwise(out)
    return out


def context(s: SparkSession, d: str) -> DataFrame:
    known = F.col("opp_rating") > 0
    return matches(s, d).select("match_id", F.when(known, (F.col("own_rating") - F.col("opp_rating")) / 1000.0).alias("gap"), F.when(known, F.least(F.col("own_rating") / F.col("opp_rating"), F.lit(6.0)) / 6).alias("ratio"))


def event_features(s: SparkSession, d: str) -> DataFrame:
    return X9.event_features(events(s, d).withColumn("ability", F.col("k") % 10 == 0), context(s, d), item_type(), SPELL, zone_value())


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    """Items in order from 2 on; 0 is for padding and 1 for what is unknown."""
    return events(s, d).select("item").distinct().withColumn("index", F.row_number().over(Window.orderBy("item")) + 1)


_eight = lambda df, *keys: df.select(*keys, *(F.round(c, 8).alias(c) for c in X9.FEATURES))
_U = f"{X9.UNITS}::double"
_HIT = "case " + " ".join(f"when x between {x0} and {x1} and y between {y0} and {y1} then {w}::double" for _, x0, y0, x1, y1, w in ZONES) + " end"
_DELIVER = lambda v, name: f"{name} as (select coalesce(target, last) as event_id, sum(value) as value from {v} asof left join b0 on {v}.match_id = b0.match_id and {v}.impact <= b0.t join l0 on l0.match_id = {v}.match_id group by 1)"
_PHASES = ", ".join(f"(tick >= {lo} and tick < {hi})::int::double as {name}" for name, lo, hi in zip(X9.BASE[2:6], (-(10**9), 3360, 5280, 7920), (3360, 5280, 7920, 10**9)))
_F = f"""with recursive {_states()}, {M_SQL}, {_ORIENT}, qq as (select * from s where i > 0),
held as (select a.event_id, a.before as own, least(10.0, coalesce(max_by(b.after - b.g, (b.tick, b.event_id)), 5.0) + any_value(a.g)) as other
 from qq a left join qq b on b.match_id = a.match_id and b.side != a.side and (b.tick, b.event_id) < (a.tick, a.event_id) group by 1, 2),
v1 as (select a.match_id, a.tick + {X9.IMPACT} as impact, max(b.cost)::double as value from e a join e b on b.match_id = a.match_id and b.side = 'opponent' and b.tick between a.tick and a.tick + {X9.TICKS_AROUND}
 and sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= {X9.RADIUS} where a.side = 'team' and a.item = '{SPELL}' group by a.event_id, a.match_id, a.tick),
v2 as (select match_id, tick + {X9.IMPACT} as impact, {_HIT} as value from e where side = 'team' and item = '{SPELL}' and {_HIT} is not null),
b0 as (select match_id, tick as t, min(event_id) as target from e group by 1, 2), l0 as (select match_id, arg_max(event_id, (tick, event_id)) as last from e group by 1), {_DELIVER('v1', 'd1')}, {_DELIVER('v2', 'd2')},
turned as (select match_id, event_id, side, item, tick, cost, k, case when rotated then 17325 - x else x end as x, case when rotated then 31500 - y else y end as y, row_number() over (partition by match_id, side order by tick, event_id) as play from o),
f as (select t.match_id, t.event_id, t.tick as "at", t.item, (side = 'team')::int::double as side, round(least(tick / {X9.TICKS}, 1), 8) as tick, {_PHASES},
 round((x - {X9.MIDDLE_X}) / {X9.MIDDLE_X}, 8) as x, round((y - {X9.MIDDLE_Y}) / {X9.MIDDLE_Y}, 8) as y, (x < {X9.MIDDLE_X - X9.LANE})::int::double as lane_left, (x > {X9.MIDDLE_X + X9.LANE})::int::double as lane_right,
 (x between {X9.MIDDLE_X - X9.LANE} and {X9.MIDDLE_X + X9.LANE})::int::double as lane_center, round(least(play, {X9.PLAYS}) / {X9.PLAYS}, 8) as play, (k % 10 = 0)::int::double as ability, cost / {_U} as cost,
 (t.item in ('click', 'view'))::int::double as type_troop, (t.item = 'purchase')::int::double as type_spell, (t.item = 'error')::int::double as type_building,
 round(own / {_U}, 8) as own, round(other / {_U}, 8) as other, round((own - other) / {_U}, 8) as differential,
 round(coalesce(case when opp_rating > 0 then (own_rating - opp_rating) / 1000.0::double end, 0), 8) as gap, round(coalesce(case when opp_rating > 0 then least(own_rating / opp_rating, 6) / 6 end, 0), 8) as ratio,
 round(coalesce(d1.value, 0) / {_U}, 8) as connect, round(coalesce(d2.value, 0) / {_U}, 8) as zone
 from turned t left join held using (event_id) left join m on m.match_id = t.match_id left join d1 on d1.event_id = t.event_id left join d2 on d2.event_id = t.event_id)"""
add("f9_event_features", lambda s, d: _eight(event_features(s, d), "match_id", "event_id"), f"{_F} select match_id, event_id, {', '.join(X9.FEATURES)} from f")
_TOTAL = " + ".join(X9.FEATURES)


def _padded(s: SparkSession, d: str) -> DataFrame:
    """Padded sequences, each place of a feature rounded, as one row a match: its items, mask and the sums of its rows of features."""
    p = X9.padded(_eight(event_features(s, d), "match_id", "event_id", "at", "item"), X9.FEATURES, LENGTH, vocabulary(s, d))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    sums = F.transform("features", lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + x))
    return p.select("match_id", "n", text("items").alias("items"), text("mask").alias("mask"), F.size("features").alias("length"), F.round(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


add("f9_padded_sequences", _padded,
    f"""{_F}, voc as (select item, row_number() over (order by item) + 1 as index from (select distinct item from e)),
i as (select *, row_number() over (partition by match_id order by "at", event_id) as i from f join voc using (item)),
g as (select match_id, count(*)::int as n, list(index order by i) as items, sum({_TOTAL}) as total from i where i <= {LENGTH} group by 1)
select match_id, n, array_to_string(list_concat(items, [0 for x in range({LENGTH} - n)]), ',') as items, array_to_string(list_concat([1 for x in range(n)], [0 for x in range({LENGTH} - n)]), ',') as mask, {LENGTH}::int as length, round(total, 4) as total from g""")

# --- one category in depth --------------------------------------------------------------------------------------------------------


def _metrics(s: SparkSession, d: str) -> DataFrame:
    """Matches of every third user as the category; won is the user's parity."""
    e = events(s, d).where("match_id % 3 = 0")
    return D9.metrics(e, e.select("match_id", (F.col("match_id") % 2).alias("won")).distinct(), item_type())


_SHARE = lambda c, of: f"count(*) filter ({of} and {c}) / nullif(count(*) filter ({of}), 0)"
_LANE = {"left": "x < 7500", "right": "x > 10500", "center": "x between 7500 and 10500"}
_TYPE = {"troop": "item in ('click', 'view')", "spell": "item = 'purchase'", "building": "item = 'error'"}
_ROWS = lambda frame, names: " union all ".join(f"select won, '{n}'{' || phase' if frame == 'ph' else ''} as metric, {n.rstrip('_')}::double as value from {frame} where {n.rstrip('_')} is not null" for n in names)
_M9 = f"""{_states().replace(E_SQL, E_SQL.replace('from events', 'from events where user_id % 3 = 0'))}, z as (select match_id, max(tick) as e_end from e group by 1),
lk as (select match_id, sum(over) + greatest(0, max_by(after - g, i) + any_value({_grown('e_end')}) - 10) as overflow from s join z using (match_id) where side = 'team' group by 1),
ss as (select *, sum(fresh) over (partition by match_id order by tick, event_id) as session from (select *, case when tick - lag(tick) over (partition by match_id order by tick, event_id) <= 300 then 0 else 1 end as fresh from e where side = 'team')),
pu as (select match_id, count(*) as pushes, min(start) as first_push from (select match_id, session, min(tick) as start from ss group by 1, 2 having count(*) >= 3) group by 1),
gm as (select match_id % 2 as won, match_id, max(tick) as duration, min(tick) filter (side = 'team') as first_play, count(*) filter (side = 'team') as plays from e group by 1, 2),
pg as (select won, count(*) as games, avg(duration) as duration, avg(overflow) as overflow, avg(first_play) as first_play, avg(plays) as plays, avg(coalesce(pushes, 0)) as pushes, avg(first_push) as first_push from gm left join pu using (match_id) left join lk using (match_id) group by 1),
w as (select match_id % 2 as won, {_SHARE('y > 15750', "side = 'team'")} as aggression, {', '.join(f'''{_SHARE(c, "side = 'team'")} as lane_{n}''' for n, c in _LANE.items())} from e group by 1),
ph as (select match_id % 2 as won, case when tick >= 7920 then 'late' when tick >= 5280 then 'overtime' when tick >= 3360 then 'double' else 'single' end as phase,
 {', '.join(f'''{_SHARE(c, "side = 'team'")} as lane_{n}''' for n, c in _LANE.items())}, {', '.join(f'''{_SHARE(c, "side = 'opponent'")} as opponent_{n}''' for n, c in _TYPE.items())} from e group by 1, 2),
mt as ({_ROWS('pg', ['games', 'duration', 'overflow', 'first_play', 'plays', 'pushes', 'first_push'])} union all {_ROWS('w', ['aggression', 'lane_left', 'lane_right', 'lane_center'])}
 union all {_ROWS('ph', ['lane_left_', 'lane_right_', 'lane_center_', 'opponent_troop_', 'opponent_spell_', 'opponent_building_'])})"""
_RULES9 = ", ".join(f"('{r.name}', '{r.a}', {r.a_won}, '{r.b}', {r.b_won}, {float(r.threshold)!r}::double, {r.needs})" for r in D9.RULES)
_r6 = lambda df, *cols: df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))
add("c9_metrics", lambda s, d: _r6(_metrics(s, d), "value"), f"with recursive {_M9} select won, metric, round(value, 6) as value from mt")
add("c9_deep_dive", lambda s, d: _r6(D9.deep_dive(_metrics(s, d)), "win_rate", "duration", "overflow_in_wins", "overflow_in_losses"),
    f"""with recursive {_M9}, pv as (select coalesce(max(games) filter (won = 1), 0) as wins, coalesce(max(games) filter (won = 0), 0) as losses, sum(games * duration) / sum(games) as duration, max(overflow) filter (won = 1) as ow, max(overflow) filter (won = 0) as ol from pg)
select wins + losses as games, wins, losses, round(wins / (wins + losses), 6) as win_rate, round(duration, 6) as duration, round(ow, 6) as overflow_in_wins, round(ol, 6) as overflow_in_losses from pv""")
add("c9_patterns", lambda s, d: _r6(D9.patterns(_metrics(s, d)), "a", "b", "difference"),
    f"""with recursive {_M9}, rl(rule, am, aw, bm, bw, threshold, needs) as (values {_RULES9}), j as (select rule, x.value as a, y.value as b, threshold, needs from rl join mt x on x.metric = am and x.won = aw join mt y on y.metric = bm and y.won = bw)
select rule, round(a, 6) as a, round(b, 6) as b, round(a - b, 6) as difference from j where abs(a - b) > threshold and (needs = 0 or (needs = 1 and (a > 0 or b > 0)) or (needs = 2 and a > 0 and b > 0))""")

# --- how an entity plays: users as matches of entities by their number ----------------------------------------------------------------

GATES = (3, 10, 5)
add("c22_fingerprint", lambda s, d: _r6(PF.fingerprint(events(s, d), events(s, d).select("match_id", (F.col("match_id") % 4).alias("entity")).distinct(), GATES), *PF.FEATURES),
    f"""with {E_SQL}, t as (select *, tick - max(case when side = 'opponent' then tick end) over (partition by match_id order by tick range between unbounded preceding and 1 preceding) as since,
 lead(tick) over (partition by match_id, side order by tick, event_id) - tick as nx, count(*) over (partition by match_id, side) as plays from e),
p as (select match_id % 4 as entity, match_id, tick, cost, case when nx > 0 and nx <= {PF.GAP} then nx / cost end as pace, case when since <= {PF.REACTION} then since end as reaction, case when since <= {PF.REACTION} and y < {PF.MIDDLE_Y} then since end as defence from t where side = 'team' and plays >= 2),
g as (select entity, count(*) as games, sum(span) as span, sum(spent) as spent from (select entity, match_id, max(tick) - min(tick) as span, sum(cost) as spent from p group by 1, 2) group by 1),
q as (select entity, count(pace) as paces, count(reaction) as reactions, count(defence) as defences, quantile_cont(pace, 0.5) as pace, stddev_pop(pace) / avg(pace) as pc, quantile_cont(reaction, 0.5) as reaction, quantile_cont(defence, 0.5) as defence, avg((reaction <= {PF.FAST})::int) as fast from p group by 1)
select entity, games, round(pace, 6) as pace, round(spent / span * 1000, 6) as throughput, round(reaction, 6) as reaction, round(pc, 6) as pace_consistency, round(case when defences >= {PF.LEAST_DEFENCE} then defence else reaction end, 6) as defence_reaction, round(fast, 6) as fast_share
from g join q using (entity) where games >= {GATES[0]} and paces >= {GATES[1]} and reactions >= {GATES[2]} and span > 0""")
