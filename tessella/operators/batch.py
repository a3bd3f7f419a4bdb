"""Several grouped statements over one table in one scan.

Each row is dealt to the statements whose filter it passes, as one small record with the statement's
number, its key and its values; one aggregation with partial sums serves them all. Other
statements run alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import SPARK, Kind, Typed
from ..functions.registry import AGGREGATES
from ..plans import syntax as X
from ..plans.binder import Binder, Scope, conjuncts, walk
from ..plans.relation import Relation

FUSED = ("count", "sum", "min", "max")


@dataclass
class Plan:
    """A statement that can share a scan."""

    query: X.Query
    relation: Relation
    where: Typed | None
    key: Typed | None
    key_expr: X.Expr | None
    items: list[tuple[str, Typed | None]]  # "key", "count_all" or an aggregate, and its argument


def plan_of(binder: Binder, query: X.Query, relation: Relation) -> Plan | None:
    """None if the statement has another shape; errors of binding are left to the run alone."""
    if query.ctes or query.joins or query.source.query is not None or len(query.group_by) > 1:
        return None
    parts = [i.expr for i in query.items] + conjuncts(query.where)
    if any(isinstance(x, (X.InQuery, X.Exists)) for e in parts for x in walk(e)):
        return None
    scope = Scope(relation, {})
    items = list(query.items)
    if any(isinstance(i.expr, X.Star) for i in items):
        return None
    key_expr = binder.target(query.group_by[0], items, relation, "GROUP BY", True) if query.group_by else None
    if key_expr is not None and any(isinstance(x, X.Call) and x.name in AGGREGATES for x in walk(key_expr)):
        return None
    key = binder.expr(key_expr, scope) if key_expr is not None else None
    if key is not None and key.kind not in (Kind.TEXT, Kind.INT, Kind.DATE):
        return None
    named = binder.normalized(key_expr, relation) if key_expr is not None else None
    found: list[tuple[str, Typed | None]] = []
    for i in items:
        e = i.expr
        if named is not None and binder.normalized(e, relation) == named:
            found.append(("key", None))
        elif isinstance(e, X.Call) and e.name in FUSED and len(e.args) == 1:
            if isinstance(e.args[0], X.Star):
                found.append(("count_all", None))
                continue
            arg = binder.expr(e.args[0], scope)
            if arg.kind in (Kind.BOOL, Kind.NULL) or e.name == "sum" and not arg.kind.numeric:
                return None
            found.append((e.name, Typed(arg.to(Kind.INT), Kind.INT) if e.name == "sum" and arg.kind.temporal else arg))
        else:
            return None
    for o in query.order_by:
        target = binder.target(o.expr, items, relation, "ORDER BY", False)
        if not any(target == i.expr for i in items):
            return None
    where = binder.expr(query.where, Scope(relation, {}, where=True)) if query.where is not None else None
    if where is not None and where.kind is not Kind.BOOL:
        return None
    return Plan(query, relation, where, key, key_expr, found)


def run(binder: Binder, plans: list[Plan]) -> list[Relation]:
    """Results in order; all plans are over one relation."""
    source = plans[0].relation
    kinds = sorted({a.kind.value for p in plans for _, a in p.items if a is not None})
    widest = {k: max(sum(a is not None and a.kind.value == k for _, a in p.items) for p in plans) for k in kinds}
    slots = [(k, i) for k in kinds for i in range(widest[k])]
    used: dict[tuple[str, int], set[str]] = {s: set() for s in slots}
    places: list[list[tuple[str, int] | None]] = []
    stands = []
    for number, p in enumerate(plans):
        at = dict.fromkeys(kinds, 0)
        mine: dict[tuple[str, int], Typed] = {}
        place: list[tuple[str, int] | None] = []
        for name, arg in p.items:
            if arg is None:
                place.append(None)
                continue
            slot = (arg.kind.value, at[arg.kind.value])
            at[arg.kind.value] += 1
            mine[slot] = arg
            used[slot].add(name)
            place.append(slot)
        places.append(place)
        null = lambda k: F.lit(None).cast(SPARK[k])
        fields = [F.lit(number).alias("s"), *((p.key.col if p.key is not None and p.key.kind is k else null(k)).alias(f"k_{k.value}") for k in (Kind.TEXT, Kind.INT, Kind.DATE))]
        fields += [(mine[s].col if s in mine else null(Kind(s[0]))).alias(f"v_{s[0]}_{s[1]}") for s in slots]
        record = F.struct(*fields)
        stands.append(F.when(p.where.col, record) if p.where is not None else record)
    each = source.df.select(F.explode(F.filter(F.array(*stands), lambda r: r.isNotNull())).alias("r")).select("r.*")
    builders = {"count": F.count, "sum": lambda c: F.sum(c), "min": F.min, "max": F.max}
    asked = [F.count(F.lit(1)).alias("n")]
    for (k, i), names in used.items():
        for name in sorted(names):
            c = F.col(f"v_{k}_{i}")
            asked.append((F.try_sum(c) if name == "sum" and k != "float" else builders[name](c)).alias(f"{name}_{k}_{i}"))
    table = each.groupBy("s", "k_text", "k_int", "k_date").agg(*asked)
    # kept, as several results read it, for as long as the catalog keeps what statements share
    key = f"(batch {[p.query for p in plans]!r} over {source.key})"
    for _ in range(2):
        table = binder.catalog.derived(key, lambda: Relation(table, (), key)).df
    return [_result(binder, p, place, table, number) for number, (p, place) in enumerate(zip(plans, places, strict=True))]


def _result(binder: Binder, p: Plan, place: list[tuple[str, int] | None], table: DataFrame, number: int) -> Relation:
    own = table.where(F.col("s") == number)
    if p.key is None:  # one row, with counts of 0, even where no row passes
        one = table.sparkSession.range(1).select(F.lit(number).alias("one"))
        own = one.join(own, F.col("one") == F.col("s"), "left")
    bound = []
    for (name, arg), slot in zip(p.items, place, strict=True):
        if name == "key":
            bound.append(Typed(F.col(f"k_{p.key.kind.value}"), p.key.kind))
        elif name == "count_all":
            bound.append(Typed(F.coalesce("n", F.lit(0).cast("long")), Kind.INT))
        else:
            c = F.col(f"{name}_{slot[0]}_{slot[1]}")
            bound.append(Typed(F.coalesce(c, F.lit(0).cast("long")), Kind.INT) if name == "count" else Typed(c, arg.kind))
    order = []
    items = list(p.query.items)
    for o in p.query.order_by:
        target = binder.target(o.expr, items, p.relation, "ORDER BY", False)
        order.append((bound[next(i for i, x in enumerate(items) if x.expr == target)], o.descending))
    return binder.finish(p.query, items, bound, order, lambda columns: own.select(columns), p.relation)

