"""Queries of the capped resource: at plays, each second, on average, overflow, and how well settings predict spending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import resources as P
from ..sources.views import E_SQL, events
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add


def _grown(t: str, schedule=P.SCHEDULE) -> str:
    return " + ".join(f"greatest(0, least({t}, {hi!r}::double) - {lo!r}::double) * {rate!r}::double" for lo, hi, rate in schedule)


def _states(ahead: int = 0) -> str:
    """SQL: plays one after another, each side of each match a recursion."""
    return f"""{E_SQL}, p as (select match_id, side, tick, event_id, cost, {_grown(f'(tick + {ahead})')} as g, row_number() over (partition by match_id, side order by tick, event_id) as i from e),
s as (select match_id, side, 0::bigint as i, null::int as tick, null::bigint as event_id, 0::int as cost, 0::double as g, null::double as before, {P.START}::double as after, 0::double as over from p where i = 1
 union all select p.match_id, p.side, p.i, p.tick, p.event_id, p.cost, p.g, least({P.CAP}, s.after + p.g - s.g), greatest(0, least({P.CAP}, s.after + p.g - s.g) - p.cost), greatest(0, s.after + p.g - s.g - {P.CAP})
 from s join p on p.match_id = s.match_id and p.side = s.side and p.i = s.i + 1)"""


def _curve(ahead: int) -> str:
    """SQL: a grid of seconds for both sides of every match, each point looking up its side's last play."""
    return f"""{_states(ahead)}, z as (select match_id, max(tick) as e_end from e group by 1),
grid as (select match_id, side, unnest(range(0, e_end + {P.SECOND} + 1, {P.SECOND})) as sec from z, (values ('team'), ('opponent')) v(side)),
q as (select match_id, side, coalesce(tick, -1) as tick, i, after - g as y from s),
c as (select grid.match_id, grid.side, sec, least({P.CAP}, coalesce(max_by(y, i), {P.START}) + {_grown(f'(sec + {ahead})')}) as level
 from grid left join q on q.match_id = grid.match_id and q.side = grid.side and q.tick <= sec group by 1, 2, 3)"""


_rounded = lambda df, *cols, places=5: df.select(*(F.round(c, places).alias(c) if c in cols else c for c in df.columns))
states = lambda s, d, ahead=0: P.resource_states(events(s, d), ahead=ahead)

add("c13_resource_states", lambda s, d: _rounded(states(s, d).select("event_id", "before", "after", "overflow"), "before", "after", "overflow"),
    f"with recursive {_states()} select event_id, round(before, 5) as before, round(after, 5) as after, round(over, 5) as overflow from s where i > 0")
add("c13_overflow", lambda s, d: _rounded(P.resource_overflow(states(s, d)), "overflow"),
    f"""with recursive {_states()}, z as (select match_id, max(tick) as e_end from e group by 1),
t as (select match_id, side, sum((i > 0)::int)::bigint as n, sum(cost)::double as spent, sum(over) as over, max_by(after - g, i) as y from s group by 1, 2)
select match_id, side, n, spent, round(over + greatest(0, y + {_grown('e_end')} - {P.CAP}), 5) as overflow from t join z using (match_id)""")
add("c14_resource_at_events", lambda s, d: _rounded(P.resource_at_events(states(s, d)).drop("match_id"), "own", "other", "differential"),
    f"""with recursive {_states()}, q as (select * from s where i > 0),
o as (select a.event_id, a.side, a.before as own, least({P.CAP}, coalesce(max_by(b.after - b.g, (b.tick, b.event_id)), {P.START}) + any_value(a.g)) as other
 from q a left join q b on b.match_id = a.match_id and b.side != a.side and (b.tick, b.event_id) < (a.tick, a.event_id) group by 1, 2, 3)
select event_id, side, round(own, 5) as own, round(other, 5) as other, round(own - other, 5) as differential from o""")
add("c12_resource_curve", lambda s, d: _rounded(P.resource_curve(states(s, d, 1), ahead=1), "level"),
    f"with recursive {_curve(1)} select match_id, side, sec::bigint as \"at\", round(level, 5) as level from c")
add("c15_average_differential", lambda s, d: _rounded(P.average_differential(P.resource_curve(states(s, d, 1), ahead=1), events(s, d).select("match_id", (F.col("match_id") % 2).alias("won")).distinct(), "won"), "mean", places=7),
    f"""with recursive {_curve(1)}, w as (select match_id % 2 as won, sec, sum(case when side = 'team' then level else -level end) as d, count(*) filter (side = 'team') as n from c group by 1, 2),
k as (select match_id % 2 as won, count(distinct match_id) as matches from e group by 1)
select won, sec::bigint as "at", round(d / n, 7) as mean, n from w join k using (won) where n >= greatest(2, matches // 3)""")


def _setting(per_second: float) -> tuple:
    """The schedule if a second had so many ticks: its edges lie at the same seconds and a tick regrows the same units a second."""
    return tuple((lo * per_second / P.SECOND, hi * per_second / P.SECOND, rate * P.SECOND / per_second) for lo, hi, rate in P.SCHEDULE)


#: Ticks a second, units at the start, and whether growth counts up to the match's end.
GRID = [(per_second, start, to_end) for per_second in (20.0, 20.5) for start in (5.0, 7.0) for to_end in (True, False)]


def _grid(s: SparkSession, d: str) -> DataFrame:
    """What each side overflowed by the trace under every setting, against the overflow reported for it (here a sum of its events' k)."""
    e, out = events(s, d), None
    truth = e.groupBy("match_id", "side").agg((F.sum("k") / 100).alias("truth"))
    for per_second, start, to_end in GRID:
        schedule = _setting(per_second)
        pred = P.resource_overflow(P.resource_states(e, schedule, start=start), schedule, to_end=to_end).select("match_id", "side", F.col("overflow").alias("pred"))
        one = pred.join(truth, ["match_id", "side"]).select(F.lit(per_second).alias("per_second"), F.lit(start).alias("start"), F.lit(to_end).alias("to_end"), "pred", "truth")
        out = one if out is None else out.unionByName(one)
    return _rounded(V.validate_grid(out, ["per_second", "start", "to_end"]), "mae", "bias", "corr")


_CASES = " union all ".join(f"select {p!r}::double as per_second, {s!r}::double as start, {t}::boolean as to_end" for p, s, t in GRID)
_G = lambda t: _grown(f"({t} * {P.SECOND} / per_second)")  # seconds, in ticks of the schedule as it stands
add("j29_validate_trace", _grid,
    f"""with recursive {E_SQL}, x as ({_CASES}),
p as (select per_second, start, to_end, match_id, side, cost, {_G('tick')} as g, row_number() over (partition by per_second, start, to_end, match_id, side order by tick, event_id) as i from e, x),
s as (select distinct per_second, start, to_end, match_id, side, 0::bigint as i, start as y, 0::double as over from p
 union all select p.per_second, p.start, p.to_end, p.match_id, p.side, p.i, greatest(0, least({P.CAP}, s.y + p.g) - p.cost) - p.g, s.over + greatest(0, s.y + p.g - {P.CAP})
 from s join p on p.match_id = s.match_id and p.side = s.side and p.per_second = s.per_second and p.start = s.start and p.to_end = s.to_end and p.i = s.i + 1),
t as (select per_second, start, to_end, match_id, side, max_by(over, i) as over, max_by(y, i) as y from s group by 1, 2, 3, 4, 5),
z as (select match_id, max(tick) as e_end from e group by 1), h as (select match_id, side, sum(k) / 100 as truth from e group by 1, 2),
q as (select per_second, start, to_end, over + case when to_end then greatest(0, y + {_G('e_end')} - {P.CAP}) else 0 end as pred, truth from t join z using (match_id) join h using (match_id, side)),
r as (select per_second, start, to_end, count(*) as n, avg(abs(pred - truth)) as mae, avg(pred - truth) as bias, corr(pred, truth) as c from q group by 1, 2, 3)
select per_second, start, to_end, n, round(mae, 5) as mae, round(bias, 5) as bias, round(c, 5) as corr, row_number() over (order by mae, per_second, start, to_end) = 1 as best from r""")
