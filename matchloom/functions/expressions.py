"""Column expressions: tags, forms, basket rules, phases, lanes, encodings, bins. Built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_tag(c) -> Column:
    """Upper case with exactly one leading #; null stays null."""
    t = F.upper(F.trim(_c(c)))
    return F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t))


def variant(level) -> Column:
    """base, evo or hero for a form level of 0 or null, 1, and 2 or more."""
    return F.when(_c(level) >= 2, "hero").when(_c(level) == 1, "evo").otherwise("base")


def classify_basket(items: Column, rules: Sequence[tuple[str, Sequence[str], int]], default: str = "other") -> Column:
    """Label of the first rule (label, items, least) of which a basket holds at least that many different items."""
    out = F.lit(default)
    for label, wanted, least in reversed(rules):
        have = F.size(F.array_intersect(items, F.array(*map(F.lit, wanted))))
        out = F.when(have >= least, label).otherwise(out)
    return out


def basket_hash(items: Column) -> Column:
    """16 hex digits that do not depend on the items' order."""
    return F.substring(F.md5(F.array_join(F.array_sort(items), "|")), 1, 16)


def match_id(*parts) -> Column:
    """32 hex digits of the SHA-256 of the parts in canonical form."""
    return F.substring(F.sha2(F.concat_ws('", "', *(_c(p).cast("string") for p in parts)), 256), 1, 32)


def displayed_level(level, top, cap: int) -> Column:
    return _c(level) + (F.lit(cap) - _c(top))


def by_edges(value, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open range a value lies in: labels[0] below edges[0], then one more for each edge reached."""
    out = F.lit(labels[0])
    for edge, label in zip(edges, labels[1:]):
        out = F.when(_c(value) >= edge, label).otherwise(out)
    return F.when(_c(value).isNull(), None).otherwise(out)


PHASE_EDGES, PHASES = (3360, 5280, 7920), ("single", "double", "overtime", "late")


def phase(tick, edges: Sequence[float] = PHASE_EDGES, labels: Sequence[str] = PHASES) -> Column:
    return by_edges(tick, edges, labels)


def lane(x, low: float = 7500, high: float = 10500) -> Column:
    return F.when(_c(x) < low, "left").when(_c(x) > high, "right").otherwise("center")


def one_hot(c, values: Sequence) -> list[Column]:
    return [F.when(_c(c) == v, 1).otherwise(0).alias(f"is_{v}") for v in values]


def cyclical(value, period: float) -> tuple[Column, Column]:
    angle = _c(value) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def regenerated(start, end, schedule: Sequence[tuple[float, float, float]]) -> Column:
    """Integral from start to end of a piecewise-constant rate; schedule has (from, to, rate)."""
    total = F.lit(0.0)
    for low, high, rate in schedule:
        total = total + F.greatest(F.lit(0.0), F.least(_c(end), F.lit(high)) - F.greatest(_c(start), F.lit(low))) * F.lit(rate)
    return total


def platt(logit, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * _c(logit) + F.lit(b)))


def to_logit(p, eps: float = 1e-6) -> Column:
    c = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(c / (1 - c))


def gauss_similarity(distance, sigma) -> Column:
    return F.exp(-_c(distance) * _c(distance) / (2 * _c(sigma) * _c(sigma)))


def width_bucket(value, low: float, high: float, n: int) -> Column:
    """0 below low, n + 1 from high on, else the number of the equal-width bin."""
    v = _c(value)
    return F.when(v < low, 0).when(v >= high, n + 1).otherwise(F.floor((v - low) * n / (high - low)).cast("int") + 1)


def edge_bucket(value, edges: Sequence[float]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(_c(value) >= edge, 1).otherwise(0)
    return F.when(_c(value).isNull(), None).otherwise(out)


def slug(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-")


def kebab_to_title(c) -> Column:
    return F.initcap(F.replace(_c(c), F.lit("-"), F.lit(" ")))


def alnum_key(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


def parse_number(c) -> Column:
    """The digits, sign and point of a noisy text as a number; null where nothing is left."""
    return F.regexp_replace(_c(c), "[^0-9.-]", "").try_cast("double")


def basket_distance(a: Column, b: Column, size: int = 8) -> Column:
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.lit(size) - F.size(F.array_intersect(a, b)))
