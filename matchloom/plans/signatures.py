"""Queries of quantile sketches and of the verification of signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import neighbours as B
from ..operators import residuals as R
from ..operators import sketches as K
from ..operators import verification as W
from ..sources.views import table
from .evaluation import _SIG
from .register import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle
add = reg.add

# --- sketches: every label's vectors in two halves by id, so each group has a twin of the same distribution -------------------

DIMS, SLICES, LEVELS, SEED = 64, 16, 16, 7
THETA, QS = K.directions(DIMS, SLICES, SEED), K.levels(LEVELS)


def halves(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").withColumn("part", F.col("label") * 2 + F.col("vec_id") % 2)


def sketches(s: SparkSession, d: str, centre: bool) -> DataFrame:
    return K.sliced_sketch(halves(s, d), ["part"], THETA, QS, centre=centre)


def _sketch_rows(s: SparkSession, d: str, centre: bool) -> DataFrame:
    return sketches(s, d, centre).select("part", "n", F.posexplode("sketch").alias("place", "x")).select("part", "n", "place", F.round("x", 6).alias("x"))


def _twins(s: SparkSession, d: str) -> DataFrame:
    """Each group's nearest other group by sketch, its distance, and whether it is the other half of the same label."""
    k = sketches(s, d, False).select(F.col("part").alias("vec_id"), F.col("sketch").alias("embedding"))
    near = B.nearest(k, k, 1, metric="l1")
    return near.select(F.col("query").alias("part"), F.col("vec_id").alias("nearest"), F.round(F.col("distance") / (SLICES * LEVELS), 6).alias("distance"), (F.floor(F.col("query") / 2) == F.floor(F.col("vec_id") / 2)).alias("twin"))


_THETA = ", ".join(f"({k}, {i + 1}, {x!r}::double)" for k, t in enumerate(THETA) for i, x in enumerate(t))
_QS = ", ".join(f"{q!r}::double" for q in QS)
_SKETCH = f"""theta(slice, i, t) as (values {_THETA}),
v as (select vec_id, (label * 2 + vec_id % 2)::bigint as part, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
p as (select part, slice, vec_id, sum(x * t) as x from v join theta using (i) group by 1, 2, 3),
q as (select part, slice, count(*) as n, avg(x) as mean, quantile_cont(x, [{_QS}]) as qs from p group by 1, 2 having count(*) >= {K.LEAST}),
k as (select part, n, slice, generate_subscripts(qs, 1) - 1 as j, unnest(qs) as x, mean from q)"""
for _name, _centre in (("j18_sketch", False), ("j18_sketch_centred", True)):
    add(_name, lambda s, d, c=_centre: _sketch_rows(s, d, c), f"with {_SKETCH} select part, n, (slice * {LEVELS} + j)::int as place, round(x - {'mean' if _centre else '0'}, 6) as x from k")
add("j18_nearest_twin", _twins,
    f"""with {_SKETCH}, o as (select a.part, b.part as nearest, avg(abs(a.x - b.x)) as distance from k a join k b on a.slice = b.slice and a.j = b.j and a.part != b.part group by 1, 2)
select part, nearest, round(distance, 6) as distance, part // 2 = nearest // 2 as twin from o qualify row_number() over (partition by part order by distance, nearest) = 1""")

# --- verification: vectors of twenty entities, each with a basket a label ---------------------------------------------------------


def keys(s: SparkSession, d: str) -> DataFrame:
    """(key, entity, basket, items, rating, signature): entities are vec_id % 20, baskets are labels, a basket's items the brands of eight parts."""
    e = table(s, d, "embeddings").withColumn("key", (F.col("vec_id") % 20) * 100 + F.col("label"))
    items = table(s, d, "part").where("p_partkey <= 80").groupBy((F.col("p_partkey") % 10).alias("basket")).agg(F.collect_set("p_brand").alias("items"))
    rating = e.groupBy("key").agg(F.avg("vec_id").alias("rating"))
    k = V.signatures(e.select("key", "embedding"), "key", 2).join(rating, "key")
    return k.select("key", F.floor(F.col("key") / 100).alias("entity"), (F.col("key") % 100).alias("basket"), "rating", "signature").join(items, "basket", "left")


_KEYS = f"""v0 as (select vec_id, (vec_id % 20) * 100 + label as label, embedding from embeddings), {_SIG.replace('from V', 'from v0').replace('>= 5', '>= 2')},
it as (select p_partkey % 10 as basket, list(distinct p_brand) as items from part where p_partkey <= 80 group by 1), rt as (select label, avg(vec_id) as rating from v0 group by 1),
keys as (select label as key, label // 100 as entity, label % 100 as basket, rating, signature, items from sig join rt using (label) left join it on it.basket = label % 100)"""
_FAR = "8 - len(list_intersect(a.items, b.items))"
_COS = "list_cosine_similarity(a.signature, b.signature)"


def _ordered(by: str) -> str:
    return f"(select *, row_number() over (partition by {by} order by md5(key::varchar)) as i from keys)"


_PAIRS = f"""{_KEYS}, pairs as (
 select 'positive' as kind, a.key as a, b.key as b, {_FAR} as distance, {_COS} as similarity from {_ordered('entity')} a join {_ordered('entity')} b on a.entity = b.entity and b.i - a.i between 1 and {W.FAN} where a.basket != b.basket and {_FAR} is not null
 union all select 'hard', a.key, b.key, {_FAR}, {_COS} from {_ordered('basket')} a join {_ordered('basket')} b on a.basket = b.basket and b.i - a.i between 1 and {W.FAN} where a.entity != b.entity
 union all select 'easy', a.key, b.key, {_FAR}, {_COS} from {_ordered('1')} a join {_ordered('1')} b on b.i - a.i between 1 and {W.FAN} where a.entity != b.entity and {_FAR} >= {W.FLOOR})"""


def _case(name: str, of: str, negative: str) -> str:
    return f"""select '{name}' as measure, p.n as n_pos, q.n as n_neg, round(w.wins / (p.n * q.n), 9) as auc from
 (select count(*) as n from pairs where kind = 'positive' and {of}) p, (select count(*) as n from pairs where kind = '{negative}') q,
 (select sum(case when round(x.similarity, 9) > round(y.similarity, 9) then 1 when round(x.similarity, 9) = round(y.similarity, 9) then 0.5::double else 0 end) as wins
  from (select * from pairs where kind = 'positive' and {of}) x, (select * from pairs where kind = '{negative}') y) w"""


_CASES = [("far_vs_easy", f"distance >= {W.FLOOR}", "easy"), ("far_vs_hard", f"distance >= {W.FLOOR}", "hard"), *((f"d{lo}-{hi}_vs_easy", f"distance between {lo} and {hi}", "easy") for lo, hi in W.STRATA)]
_nine = lambda df, *cols: df.select(*(F.round(c, 9).alias(c) if c in cols else c for c in df.columns))
add("j16_pairs", lambda s, d: _nine(W.verification_pairs(keys(s, d)), "similarity"), f"with {_PAIRS} select kind, a, b, distance, round(similarity, 9) as similarity from pairs")
add("j16_verification", lambda s, d: _nine(W.verification_report(W.verification_pairs(keys(s, d))), "auc"), f"with {_PAIRS} " + " union all ".join(_case(*c) for c in _CASES))
_ASKED = lambda s, d: (lambda k: W.retrieval(k, k.where("key % 50 = 0")))(keys(s, d))
_RANKS = f"""{_KEYS}, q as (select a.key, max({_COS}) as best from keys a join keys b on a.entity = b.entity and a.key != b.key and {_FAR} >= {W.FLOOR} where a.key % 50 = 0 group by 1),
ranks as (select a.key as query, 1 + count(*) filter ({_FAR} >= {W.FLOOR} and {_COS} > best + 1e-12) as rank from keys a join q using (key), keys b group by 1)"""
add("j16_retrieval_ranks", _ASKED, f"with {_RANKS} select query, rank from ranks")
add("j16_retrieval", lambda s, d: _nine(W.retrieval_report(_ASKED(s, d)), "mrr", "recall_1", "recall_5"),
    f"with {_RANKS} select count(*) as queries, round(avg(1 / rank), 9) as mrr, round(avg((rank <= 1)::int), 9) as recall_1, round(avg((rank <= 5)::int), 9) as recall_5 from ranks")


def _controls(s: SparkSession, d: str) -> DataFrame:
    """Keys whose number 50 divides, each against the mean of its entity's other signatures, among other entities' keys."""
    k = keys(s, d)
    asked = k.where("key % 50 = 0")
    others = asked.select(F.col("key").alias("id"), "entity").join(k.select("entity", "key", "signature"), "entity").where("id != key").select("id", F.col("signature").alias("embedding"))
    reference = V.signatures(others, "id", 1).select(F.col("id").alias("key"), F.col("signature").alias("reference"))
    return _nine(W.percentile_among_controls(asked.join(reference, "key"), k, width=20.0), "similarity", "percentile")


add("j17_controls_of_targets", _controls,
    f"""with {_KEYS}, t as (select a.*, r.reference from keys a join (select id, list(x order by i) as reference from
 (select a.key as id, i, avg(x) as x from keys a join (select key, entity, unnest(signature) as x, generate_subscripts(signature, 1) as i from keys) b on a.entity = b.entity and a.key != b.key where a.key % 50 = 0 group by 1, 2) group by 1) r on r.id = a.key),
h as (select t.key, list_cosine_similarity(t.signature, t.reference) as similarity, t.basket = k.basket as same, abs(t.rating - k.rating) < 20 as near, list_cosine_similarity(k.signature, t.reference) < list_cosine_similarity(t.signature, t.reference) as below
 from t join keys k on k.entity != t.entity),
g as (select key, any_value(similarity) as similarity, count(*) filter (same) as sn, count(*) filter (same and below) as sb, count(*) filter (near) as bn, count(*) filter (near and below) as bb from h group by 1)
select key, round(similarity, 9) as similarity, case when sn >= 8 then sn else bn end as controls, case when sn >= 8 then 'basket' else 'band' end as pool, round(case when sn >= 8 then sb / sn when bn > 0 then bb / bn end, 9) as percentile from g""")

# --- residual signatures: eight dimensions of every vector as features, freed of their label --------------------------------------

FEATURES = 8


def residuals(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("entity"), F.col("label").alias("basket"), F.posexplode("embedding").alias("feature", "value"))
    return R.residualize(e.where(F.col("feature") < FEATURES).withColumn("value", F.col("value").cast("double")), ["basket"])


def _residual_keys(s: SparkSession, d: str, weighted: bool) -> DataFrame:
    """The residual signatures as keys of the verification."""
    r = residuals(s, d)
    k = R.residual_signatures(r, R.reliability_weights(r) if weighted else None)
    items = table(s, d, "part").where("p_partkey <= 80").groupBy((F.col("p_partkey") % 10).alias("basket")).agg(F.collect_set("p_brand").alias("items"))
    return k.join(items, "basket", "left").select((F.col("entity") * 100 + F.col("basket")).alias("key"), "entity", "basket", "items", "signature")


def _variants(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, weighted in (("all", False), ("weighted", True)):
        one = W.verification_report(W.verification_pairs(_residual_keys(s, d, weighted))).where("measure = 'far_vs_hard'")
        one = R.with_bound(one).select(F.lit(name).alias("variant"), "auc", "low")
        out = one if out is None else out.unionByName(one)
    return out


def _residual_sql(weighted: bool) -> str:
    return f"""f as (select vec_id as id, vec_id % 20 as entity, label as basket, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as feature from embeddings),
c as (select basket, feature, avg(value) as mean, stddev_pop(value) as sd from f where feature < {FEATURES} group by 1, 2),
r as (select id, entity, basket, feature, case when sd > 1e-9 then (value - mean) / sd else 0 end as residual from f join c using (basket, feature)),
g as (select feature, entity, count(*)::double as n, avg(residual) as mean, var_pop(residual) as v from r group by 1, 2),
t as (select feature, count(*) as k, sum(n) as rows_, sum(n * n) as squares, sum(n * mean) as total, sum(n * mean * mean) as raw, sum(n * v) as within_ from g group by 1),
u as (select feature, (raw - total * total / rows_) / (k - 1) as b, within_ / (rows_ - k) as w, (rows_ - squares / rows_) / (k - 1) as size from t),
o as (select *, row_number() over (partition by feature, entity order by id) % 2 as odd from r),
h as (select feature, entity, avg(residual) filter (odd = 1) as x, avg(residual) filter (odd = 0) as y from o group by 1, 2),
wt as (select feature, (b - w) / (b + (size - 1) * w) as icc, sh as split_half, sqrt(greatest(0, (b - w) / (b + (size - 1) * w)) * greatest(0, coalesce(sh, 0))) as weight from u join (select feature, corr(x, y) as sh from h where x is not null and y is not null group by 1) using (feature)),
m as (select entity, basket, feature, count(*) as n, avg(residual) as m from r group by 1, 2, 3 having count(*) >= {R.LEAST}),
z as (select entity, basket, n, feature, (m - avg(m) over (partition by feature)) / (case when stddev_pop(m) over (partition by feature) > 0 then stddev_pop(m) over (partition by feature) else 1 end){' * weight' if weighted else ''} as z from m join wt using (feature)),
sg as (select entity, basket, n, list(z / greatest(norm, 1e-9) order by feature) as signature from (select *, sqrt(sum(z * z) over (partition by entity, basket)) as norm from z) group by 1, 2, 3)"""


def _variant_sql(name: str, weighted: bool) -> str:
    pairs = _PAIRS.replace(_KEYS, f"""{_residual_sql(weighted)}, it as (select p_partkey % 10 as basket, list(distinct p_brand) as items from part where p_partkey <= 80 group by 1),
keys as (select entity * 100 + basket as key, entity, basket, signature, items from sg left join it using (basket))""")
    return f"(with {pairs}, a as ({_case(*_CASES[1])}) select '{name}' as variant, n_pos, n_neg, auc from a)"


add("j30_weights", lambda s, d: _nine(R.reliability_weights(residuals(s, d)), "icc", "split_half", "weight"),
    f"with {_residual_sql(False)} select feature::int as feature, round(icc, 9) as icc, round(split_half, 9) as split_half, round(weight, 9) as weight from wt")
add("j30_signatures", lambda s, d: (lambda r: R.residual_signatures(r, R.reliability_weights(r)))(residuals(s, d)).select("entity", "basket", "n", F.posexplode("signature").alias("feature", "x")).select("entity", "basket", "n", "feature", F.round("x", 8).alias("x")),
    f"with {_residual_sql(True)} select entity, basket, n, generate_subscripts(signature, 1)::int - 1 as feature, round(unnest(signature), 8) as x from sg")
add("j30_verdict", lambda s, d: R.verdict(_variants(s, d)).select("variant", F.round("auc", 6).alias("auc"), F.round("low", 6).alias("low"), "result"),
    f"""with v as ({_variant_sql('all', False)} union all {_variant_sql('weighted', True)}),
b as (select variant, auc, auc - {R.Z} * sqrt(greatest(0, (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg))) as low from v)
select variant, round(auc, 6) as auc, round(low, 6) as low, case when auc >= {R.PASS} and low > 0.5 then 'PASS' when auc >= 0.5 and low > 0.5 then 'PARTIAL' else 'KILL' end as result from b order by auc desc, variant limit 1""")
