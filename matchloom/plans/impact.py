"""Queries of item impact, swaps, calibration by tier, replay pages, and functions registered for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import impact as M
from ..operators import outcomes as O
from ..operators import resources as P
from ..sources import ingest as I
from ..sources.views import events, matches, rosters
from .core import _RULES_SQL, RULES
from .register import Registry
from .state import _S, _W, _delta, _score

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

_r9 = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))

add("e21_item_impact", lambda s, d: M.impact_by_side(_delta(s, d).withColumn("wpa", F.round("wpa", 9)), ["tick", "event_id"]).withColumn("impact", F.round("impact", 6)),
    f"""with {_W}, g as (select match_id, item, side, sum(round(wpa, 9)::double) as total, max(abs(round(wpa, 9)::double)) as peak from w group by 1, 2, 3),
k as (select match_id, arg_min((item, side), (-total, item, side)) as carry, arg_min((item, side), (total, item, side)) as liability, arg_min((item, side), (-peak, item, side)) as critical from g group by 1),
t as (select item, side, count(*) as matches, sum(total) as impact from g group by 1, 2)
select item, side, matches, round(impact, 6) as impact, (select count(*) from k where carry = (item, side)) as carry, (select count(*) from k where liability = (item, side)) as liability, (select count(*) from k where critical = (item, side)) as critical,
 (select count(*) from k where carry = (item, side)) - (select count(*) from k where liability = (item, side)) as net from t""", "e")


def _by_category(s: SparkSession, d: str) -> DataFrame:
    """Purchases by the category of the other side's basket in the match of the same number."""
    category = O.baskets(rosters(s, d), 0).select("match_id", X.classify_basket(F.col("items"), RULES).alias("category"))
    return _r9(M.impact_by_category(_delta(s, d), category, "purchase"))


add("e22_item_impact_by_category", _by_category,
    f"""with {_W}, b as (select match_id, list(distinct item order by item) as items from r where is_player = 0 group by 1), c as (select match_id, {_RULES_SQL} as category from b)
select category, side, count(distinct match_id) as matches, count(*) as plays, round(sum(wpa), 9) as impact, round(avg(wpa), 9) as mean from w join c using (match_id) where item = 'purchase' group by 1, 2""", "er")

#: A published scorer: what a fitted one would be replaced by where results must be stated in SQL.
SCORER, INTERCEPT, SWAPS = {"cost": -0.11, "tick": 0.00007, "k": 0.013}, -0.4, [(9, 1), (5, 2), (3, 8), (3, 1)]
_Z = lambda cost: f"1 / (1 + exp(-({INTERCEPT}::double + {cost} * {SCORER['cost']}::double + tick * {SCORER['tick']}::double + k * {SCORER['k']}::double)))"
_SWAPS = f"""x(old, new) as (values {', '.join(map(str, SWAPS))}), t as (select old, new, match_id, count(*) as n, avg({_Z('new')} - {_Z('cost')}) as delta from e join x on cost = old where side = 'team' group by 1, 2, 3)"""
_swaps = lambda s, d: M.swaps(M.logistic(SCORER, INTERCEPT), events(s, d), "cost", SWAPS)
add("j26_swap_deltas", lambda s, d: _r9(_swaps(s, d)), f"with {_SWAPS} select old, new, match_id, n, round(delta, 9) as delta from t", "e")
add("j27_swap_gradient", lambda s, d: _r9(M.swap_gradient(_swaps(s, d), 2)),
    f"""with {_SWAPS}, g as (select old, new, count(*) as matches, avg(delta) as mean, {M.Z} * stddev_pop(delta) / sqrt(count(*)) as half from t group by 1, 2 having count(*) >= 2)
select row_number() over (order by mean desc, old, new)::int as rank, old, new, matches, round(mean, 9) as mean, round(mean - half, 9) as low, round(mean + half, 9) as high from g""", "e")


def _tiers(s: SparkSession, d: str) -> DataFrame:
    """Scores by how sure their own band is: five bands of the score's hundredths."""
    band = (F.floor(F.col("p") * 100) % 5).cast("int")
    return _r9(M.tier_calibration(_score(s, d), band))


add("j13_calibration_by_tier", _tiers,
    f"""with {_S}, t as (select (floor(p * 100)::int % 5)::int as tier, p, label, p < 0.1 or p > 0.9 as sure, (p >= 0.5) = (label = 1) as hit from s)
select tier, count(*) as n, round(avg(p), 9) as score, round(avg(label), 9) as rate, round(avg(p) - avg(label), 9) as gap, count(*) filter (sure) as confident, round(count(*) filter (sure) / count(*), 9) as coverage, round(count(*) filter (sure and hit) / nullif(count(*) filter (sure), 0), 9) as accuracy from t group by 1""")


def _replays(s: SparkSession, d: str) -> DataFrame:
    """Every match's replay as a page with a marker an event, parsed back into event rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    marker = F.concat(F.lit('<div class="m" data-x="'), text("x"), F.lit('" data-y="'), text("y"), F.lit('" data-c="'), text("item"), F.lit('" data-t="'), text("tick"), F.lit('" data-i="'), text("event_id"), F.lit('" data-s="'), text("side"), F.lit('"><span></span></div>'))
    e = events(s, d).select("match_id", F.struct("tick", "event_id", marker.alias("m")).alias("z"))
    pages = e.groupBy(F.col("match_id").alias("page_id")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list("z")), lambda z: z["m"]), "\n"), F.lit("</body></html>")).alias("html"))
    return I.parse_replay(pages)


add("a8_parse_replay", _replays,
    "select match_id as page_id, (row_number() over (partition by match_id order by tick, event_id) - 1)::int as n, x, y, tick, item, event_id::varchar as play, side from e", "e")

# --- library functions for SQL: classification, phases, regrowth, posterior ------------------------------------------------------------

_SCHEDULE_SQL = " + ".join(f"greatest(0D, least(b, {hi!r}D) - greatest(a, {lo!r}D)) * {rate!r}D" for lo, hi, rate in P.SCHEDULE)
_KINDS = " ".join(f"when size(array_intersect(items, array({', '.join(repr(i) for i in of)}))) >= {k} then '{name}'" for name, of, k in RULES)
SQL_FUNCTIONS = {
    "game_phase": ("tick double", "string", "case when tick is null then null when tick >= 7920 then 'late' when tick >= 5280 then 'overtime' when tick >= 3360 then 'double' else 'single' end"),
    "basket_kind": ("items array<string>", "string", f"case {_KINDS} else 'other' end"),
    "regrown": ("a double, b double", "double", _SCHEDULE_SQL),
    "posterior_mean": ("wins double, losses double", "double", "(wins + 1) / (wins + losses + 2)"),
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions that the optimiser inlines: game_phase(tick), basket_kind(items), regrown(from, to), posterior_mean(wins, losses)."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")


def _sql_functions(s: SparkSession, d: str) -> DataFrame:
    register_functions(s)
    return s.sql(
        """select e.event_id, game_phase(e.tick) as phase, round(regrown(e.tick, e.tick + 500), 6) as regrown, basket_kind(b.items) as kind, round(posterior_mean(e.k, e.cost), 9) as mean
        from {e} e join {b} b on b.match_id = e.match_id""",
        e=events(s, d), b=O.baskets(rosters(s, d)),
    )


_REGROWN = " + ".join(f"greatest(0, least(tick + 500, {hi!r}::double) - greatest(tick, {lo!r}::double)) * {rate!r}::double" for lo, hi, rate in P.SCHEDULE)
add("l5_library_functions", _sql_functions,
    f"""with b as (select match_id, list(distinct item order by item) as items from r where is_player = 1 group by 1)
select event_id, case when tick >= 7920 then 'late' when tick >= 5280 then 'overtime' when tick >= 3360 then 'double' else 'single' end as phase, round({_REGROWN}, 6) as regrown, {_RULES_SQL} as kind, round((k + 1) / (k + cost + 2), 9) as mean from e join b using (match_id)""", "er")

# --- the opponents that an entity loses to most: what they are weak against, and the entity's own record with them by category ----------

LEAST = 2


def nemeses(s: SparkSession, d: str) -> DataFrame:
    """(entity, opponent): of each entity the opponent with most losses to, ties to the smaller."""
    lost = matches(s, d).groupBy("entity", "opponent").agg(F.sum(O.is_("loss")).alias("lost")).where("lost > 0")
    return O.top_k(lost, ["entity"], [F.desc("lost"), F.col("opponent")], 1).select("entity", "opponent")


def _weaknesses(s: SparkSession, d: str) -> DataFrame:
    """Every nemesis's own matches by the category of the basket it faced, the likeliest loss first."""
    faced = O.baskets(rosters(s, d), 0).select("match_id", X.classify_basket(F.col("items"), RULES).alias("label"))
    theirs = matches(s, d).join(nemeses(s, d).select(F.col("opponent").alias("entity")).distinct(), "entity", "left_semi").join(faced, "match_id")
    return _r9(M.threats(theirs, ["entity"], LEAST))


def _record(s: SparkSession, d: str) -> DataFrame:
    """Every entity's matches against its nemesis by the category of its own basket."""
    own = O.baskets(rosters(s, d), 1).select("match_id", X.classify_basket(F.col("items"), RULES).alias("label"))
    return _r9(M.threats(matches(s, d).join(nemeses(s, d), ["entity", "opponent"]).join(own, "match_id"), ["entity", "opponent"], 1))


_NEMESES = """ln as (select entity, opponent, count(*) filter (result = 'loss') as lost from m group by 1, 2 having count(*) filter (result = 'loss') > 0),
nm as (select entity, opponent from ln qualify row_number() over (partition by entity order by lost desc, opponent) = 1)"""
_THREATS = lambda source, keys, least: f"""select {keys}, label, n, wins, losses, round((wins + 1) / (wins + losses + 2), 9) as mean, row_number() over (partition by {keys} order by (wins + 1) / (wins + losses + 2), label)::int as rank
 from (select {keys}, label, count(*) as n, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses from {source} group by all having count(*) filter (result in ('win', 'loss')) >= {least})"""  # noqa: E731
_LABELS = lambda side: f"b as (select match_id, list(distinct item order by item) as items from r where is_player = {side} group by 1), c as (select match_id, {_RULES_SQL} as label from b)"
add("e10_nemesis_weaknesses", _weaknesses, f"with {_NEMESES}, {_LABELS(0)} {_THREATS('(select m.*, label from m join c using (match_id) where entity in (select opponent from nm))', 'entity', LEAST)}", "mr")
add("e10_nemesis_record", _record, f"with {_NEMESES}, {_LABELS(1)} {_THREATS('(select m.*, label from m join nm using (entity, opponent) join c using (match_id))', 'entity, opponent', 1)}", "mr")
