"""Queries of the evaluation operators, activity features and functions registered for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import outcomes as O
from ..sources.views import events, matches, table
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

_rounded = lambda df, *cols: df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))

add("j19_icc", lambda s, d: _rounded(V.icc(matches(s, d), "opponent", "own_rating"), "icc"),
    """with g as (select opponent, count(*)::double as n, avg(own_rating) as mean, var_pop(own_rating) as v from m where own_rating is not null group by 1),
t as (select count(*) as groups, sum(n) as rows_, sum(n * n) as squares, sum(n * mean) / sum(n) as grand, sum(n * v) as within_, sum(n * mean * mean) as raw from g),
q as (select groups, (raw - rows_ * grand * grand) / (groups - 1) as msb, within_ / (rows_ - groups) as msw, (rows_ - squares / rows_) / (groups - 1) as k from t)
select groups, round((msb - msw) / (msb + (k - 1) * msw), 6) as icc from q""", "m")
add("j19_split_half", lambda s, d: _rounded(V.split_half(matches(s, d), "opponent", ["ts", "match_id"], "own_rating"), "r", "reliability"),
    """with z as (select opponent, own_rating, row_number() over (partition by opponent order by ts, match_id) % 2 as odd from m),
h as (select opponent, avg(own_rating) filter (odd = 1) as a, avg(own_rating) filter (odd = 0) as b from z group by 1 having count(*) > 1)
select count(*) as n, round(corr(a, b), 6) as r, round(2 * corr(a, b) / (1 + corr(a, b)), 6) as reliability from h""", "m")
_SIG = """c as (select label, i, avg(x::double) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from V) group by 1, 2),
k as (select label, count(*) as n from V group by 1 having count(*) >= 5),
sig as (select label, n, list(mean / len_ order by i) as signature from (select *, sqrt(sum(mean * mean) over (partition by label)) as len_ from c) join k using (label) group by 1, 2)"""
add("j15_signatures", lambda s, d: V.signatures(table(s, d, "embeddings"), "label", 5).select("label", "n", F.posexplode("signature").alias("dim", "x")).select("label", "n", "dim", F.round("x", 6).alias("x")),
    f"with {_SIG.replace('from V', 'from embeddings')} select label, n, (generate_subscripts(signature, 1) - 1)::int as dim, round(unnest(signature), 6) as x from sig")


def _percentile(s: SparkSession, d: str) -> DataFrame:
    """Odd vectors against the signatures of the even ones, among controls of the same band (a tenth of the ids)."""
    e = table(s, d, "embeddings")
    probes = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), "label", F.floor(F.col("vec_id") / 2 % 10).alias("band"), "embedding")
    return _rounded(V.percentile_among_controls(probes, V.signatures(e.where("vec_id % 2 = 0"), "label", 5), "label", "band"), "similarity", "percentile")


add("j17_percentile_vs_controls", _percentile,
    f"""with v0 as (select * from embeddings where vec_id % 2 = 0), {_SIG.replace('from V', 'from v0')},
p as (select vec_id as id, label, vec_id // 2 % 10 as band, embedding::double[] as e from embeddings where vec_id % 2 = 1),
s as (select p.id, p.label, p.band, k.label as key, list_cosine_similarity(p.e, sig.signature) as similarity from p join (select distinct band, label from p) k using (band) join sig on sig.label = k.label),
w as (select *, sum((label != key)::int) over (partition by band, key) as controls, sum((label != key)::int) over (partition by band, key order by similarity range between unbounded preceding and current row) as below from s)
select id, label, round(similarity, 6) as similarity, controls::bigint as controls, round(below / controls, 6) as percentile from w where label = key and controls > 0""")
_HIT = "h as (select match_id, ts, (result = 'win')::int::double as hit from m)"
add("j12_drift", lambda s, d: _rounded(V.drift(matches(s, d).select(O.is_("win").cast("double").alias("hit"), "ts", "match_id"), [F.col("ts"), F.col("match_id")], 200, 0.05), "newest", "history"),
    f"""with {_HIT}, n as (select hit, (row_number() over (order by ts desc, match_id desc) - 1) // 200 as block from h), b as (select block, avg(hit) as rate, count(*) as n from n group by 1),
o as (select max(rate) filter (block = 0) as newest, quantile_cont(rate, 0.5) filter (block > 0 and n = 200) as history from b)
select round(newest, 6) as newest, round(history, 6) as history, newest < history - 0.05 as drifted from o""", "m")


def _poly(c, x: str) -> str:
    out = f"({c[0]!r}::double)"
    for k in c[1:]:
        out = f"({out} * {x} + {k!r}::double)"
    return out


_Q = "((p - 0.5::double) * (p - 0.5::double))"
_TAIL = lambda q: f"{_poly(V.ACKLAM_C, f'sqrt(-2 * ln({q}))')} / {_poly(V.ACKLAM_D, f'sqrt(-2 * ln({q}))')}"
_INVERSE = f"case when p < {V.ACKLAM_LOW} then {_TAIL('p')} when p > 1 - {V.ACKLAM_LOW} then -({_TAIL('(1 - p)')}) else (p - 0.5::double) * {_poly(V.ACKLAM_A, _Q)} / {_poly(V.ACKLAM_B, _Q)} end"
add("i11_normal_scores", lambda s, d: V.normal_scores(matches(s, d), ["kind"], "own_rating", "match_id").select("match_id", F.round("normal_score", 6).alias("normal_score")),
    f"with z as (select match_id, ((row_number() over (partition by kind order by own_rating, match_id) - 0.5) / count(*) over (partition by kind))::double as p from m) select match_id, round({_INVERSE}, 6) as normal_score from z", "m")
add("i12_studentized", lambda s, d: V.studentized(matches(s, d).select("match_id", "kind", F.col("own_rating").cast("double").alias("y"), F.col("opp_rating").cast("double").alias("x")), ["kind"], "y", "x").select("match_id", F.round("residual", 5).alias("residual")),
    """with l as (select kind, regr_slope(own_rating::double, opp_rating::double) as a, regr_intercept(own_rating::double, opp_rating::double) as b from m group by 1),
r as (select match_id, kind, own_rating - (b + a * opp_rating) as gap from m join l using (kind))
select match_id, round(gap / stddev_pop(gap) over (partition by kind), 5) as residual from r""", "m")


def _versions(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", "match_id", "ts", F.when(F.col("k") % 5 > 0, F.col("k") % 5).alias("version"))


_VER = "v as (select event_id, match_id, ts, nullif(k % 5, 0) as version from e)"
add("j28_rescoring_queue", lambda s, d: V.rescoring_queue(_versions(s, d), 3, 500, [F.desc("ts"), F.desc("event_id")]).select("event_id", "version"),
    f"with {_VER} select event_id, version from v where version is null or version < 3 order by ts desc, event_id desc limit 500", "e")
add("j28_rescoring_progress", lambda s, d: _versions(s, d).groupBy(F.coalesce("version", F.lit(0)).alias("version")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("matches"), F.max("ts").alias("newest")),
    f"with {_VER} select coalesce(version, 0) as version, count(*) as n, count(distinct match_id) as matches, max(ts) as newest from v group by 1", "e")


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Spending predicted from the duration at several rates and starts against what was spent."""
    g = events(s, d).groupBy("match_id", "side").agg((F.max("tick") - F.min("tick")).alias("ticks"), F.sum("cost").cast("double").alias("truth"))
    setting = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.lit(c).alias("start")) for r in (0.002, 0.004, 0.008) for c in (5.0, 10.0)))).alias("z")
    return _rounded(V.validate_grid(g.select("ticks", "truth", setting).select("z.*", (F.col("z.start") + F.col("ticks") * F.col("z.rate")).alias("pred"), "truth"), ["rate", "start"]), "mae", "bias", "corr")


add("j29_validate_grid", _grid,
    """with g as (select match_id, side, max(tick) - min(tick) as ticks, sum(cost)::double as truth from e group by 1, 2),
p as (select rate, start, start + ticks * rate as pred, truth from g, (select unnest([0.002::double, 0.004, 0.008]) as rate), (select unnest([5.0::double, 10.0]) as start)),
q as (select rate, start, count(*) as n, avg(abs(pred - truth)) as mae, avg(pred - truth) as bias, corr(pred, truth) as c from p group by 1, 2)
select rate, start, n, round(mae, 6) as mae, round(bias, 6) as bias, round(c, 6) as corr, row_number() over (order by mae, rate, start) = 1 as best from q""", "e")


SQL_FUNCTIONS = {
    "displayed_level": ("level bigint, max_level bigint", "bigint", "level + (16 - max_level)"),
    "clean_tag": ("tag string", "string", "'#' || upper(ltrim('#', trim(tag)))"),
    "platt": ("z double, a double, b double", "double", "1 / (1 + exp(-(a * z + b)))"),
}


def register_functions(spark: SparkSession) -> None:
    """The library's scalar functions for SQL, as temporary SQL functions that the optimiser inlines."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")


def _sql_functions(s: SparkSession, d: str) -> DataFrame:
    register_functions(s)
    part = table(s, d, "part").select("p_partkey", F.concat(F.lit(" #"), F.lower("p_brand")).alias("tag"), (F.col("p_size") % 14).cast("long").alias("level"))
    return s.sql("select p_partkey, clean_tag(tag) as tag, displayed_level(level, 14) as level, round(platt(level / 10.0, 2.0, -1.0), 9) as p from {part}", part=part)


add("l5_sql_functions", _sql_functions,
    "select p_partkey, '#' || upper(p_brand) as tag, (p_size % 14 + 2)::bigint as level, round(1 / (1 + exp(-(2 * ((p_size % 14) / 10.0::double) - 1))), 9) as p from part")
