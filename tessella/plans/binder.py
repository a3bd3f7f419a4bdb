"""From syntax trees to Spark frames: names, kinds, subqueries, joins, grouping and order.

Everything is lazy but for three small checks, each cut off at one row: that a joined table's key is
unique, that an uncorrelated EXISTS holds, and whether a set of NOT IN has rows with NULLs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregate as A
from ..functions import scalar as S
from ..functions.kinds import Kind, Typed, common, literal
from ..functions.registry import AGGREGATES, FUNCTIONS, INTERNAL
from . import syntax as X
from .diagnostics import Span, SqlError, nearest, suggestion
from .relation import Field, Relation, fresh


class Catalog(Protocol):
    def table(self, name: str) -> Relation | None: ...

    def base(self) -> Relation | None: ...

    def function(self, name: str): ...

    def function_names(self) -> list[str]: ...

    def derived(self, key: str, build: Callable[[], Relation]) -> Relation: ...

    def unique(self, key: str, check: Callable[[], bool]) -> bool: ...


@dataclass
class Scope:
    """What an expression may refer to."""

    relation: Relation
    flags: dict[X.Expr, Typed]
    grouped: list[X.Expr] | None = None  # normalized; None outside grouped queries
    in_aggregate: bool = False
    where: bool = False


def conjuncts(e: X.Expr | None) -> list[X.Expr]:
    if e is None:
        return []
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, X.Binary) and e.op == "and" else [e]


def walk(e: X.Expr):
    yield e
    for c in X.children(e):
        yield from walk(c)


def has_aggregate(e: X.Expr) -> bool:
    return any(isinstance(x, X.Call) and x.name in AGGREGATES for x in walk(e))


class Binder:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    # queries

    def run(self, query: X.Query, env: dict[str, Relation] | None = None) -> Relation:
        env = dict(env or {})
        for name, part in query.ctes:
            env[name] = self.derive(part, env)
        query = replace(query, ctes=())
        wants_place = any(isinstance(x, X.Call) and x.name == "group_concat" for i in (*query.items, *query.order_by) for x in walk(i.expr))
        relation = self.source(query.source, env)
        if wants_place and query.joins:
            relation = self.placed(relation)
        for join in query.joins:
            relation = self.join(relation, join, env)
        relation, flags = self.filtered(relation, query.where, env)
        if wants_place and not query.joins:
            relation = self.placed(relation)
        items = self.expanded(query.items, relation)
        if query.group_by or any(has_aggregate(i.expr) for i in (*items, *query.order_by)):
            return self.grouped(query, items, relation, flags)
        return self.plain(query, items, relation, flags)

    def derive(self, query: X.Query, env: dict[str, Relation]) -> Relation:
        """A common table expression or subquery, which later statements may share."""
        return self.catalog.derived(self.key_of(query, env), lambda: self.run(query, env))

    def key_of(self, query: X.Query, env: dict[str, Relation]) -> str:
        base = self.catalog.base()
        return f"({query!r} over {sorted((n, r.key) for n, r in env.items())} and {base.key if base else ''})"

    @staticmethod
    def placed(relation: Relation) -> Relation:
        return replace(relation, df=relation.df.withColumn(A.POSITION, F.monotonically_increasing_id()))

    def source(self, source: X.Source, env: dict[str, Relation], joined: bool = False) -> Relation:
        """A joined table must be known; in FROM any other name means the base table."""
        if source.query is not None:
            return self.derive(source.query, env).named(source.alias or "")
        found = env.get(source.name) or self.catalog.table(source.name) or (None if joined else self.catalog.base())
        if found is None:
            near = suggestion(source.name, env)
            raise SqlError(f"there is no table {source.name}", source.span, nearest(near))
        return found.named(source.alias or source.name)

    # joins

    def join(self, left: Relation, join: X.Join, env: dict[str, Relation]) -> Relation:
        right = self.source(join.source, env, joined=True)
        alias = join.source.alias or join.source.name
        if alias in left.tables():
            raise SqlError(f"two tables here go by the name {alias}", join.source.span, "AS gives one of them another name")
        pairs = []
        for name in join.using:
            sides = [r.find(name) for r in (left, right)]
            if None in sides:
                self.unknown(name, left if sides[0] is None else right, join.span)
            pairs.append(tuple(sides))
        for a, b in join.on:
            x, y = self.side(a, left), self.side(b, right)
            if x is None or y is None:
                x, y = self.side(b, left), self.side(a, right)
            if x is None or y is None:
                bad = a if self.side(a, left) is None and self.side(a, right) is None else b
                self.unknown(bad.name, right if bad.table == alias else left, bad.span)
            pairs.append((x, y))
        for x, y in pairs:
            kinds = {x.kind, y.kind}
            if kinds & {Kind.FLOAT, Kind.BOOL} or len(kinds) > 1 and not kinds <= {Kind.INT}:
                raise SqlError(f"{x.name} is {x.kind.value} and {y.name} is {y.kind.value}, which do not make a key", join.span, "both sides of a key are whole numbers, texts, dates or timestamps")
        keys = [y for _, y in pairs]
        name = f"{right.key} by {sorted(k.own for k in keys)}"
        if not self.catalog.unique(name, lambda: is_unique(right.df, [k.inner for k in keys])):
            raise SqlError(f"{alias} has several rows of one key ({', '.join(k.name for k in keys)})", join.span, "a table is joined by a key that no two of its rows share; GROUP BY makes such a table")
        condition = None
        for x, y in pairs:
            equal = F.col(x.inner) == F.col(y.inner)
            condition = equal if condition is None else condition & equal
        taken = {f.name for f in left.fields if not f.hidden}
        inner_keys = {k.inner for k in keys}
        added = [replace(f, name=f"{alias}_{f.name}" if f.name in taken else f.name, table=alias, own=f.name, hidden=f.inner in inner_keys) for f in right.visible()]
        fields = (*left.fields, *sorted(added, key=lambda f: f.own))
        key = f"({left.key} as {sorted(left.tables())} {join.how} {right.key} as {alias} on {[(x.table, x.own, y.own) for x, y in pairs]})"
        build = lambda: Relation(left.df.join(right.df, condition, join.how), fields, key)
        # a join that comes again serves any choice of columns, as it holds all of them
        return build() if A.POSITION in left.df.columns else self.catalog.derived(key, build)

    @staticmethod
    def side(column: X.Column, relation: Relation) -> Field | None:
        return relation.find(column.name, column.table)

    # conditions

    def filtered(self, relation: Relation, where: X.Expr | None, env: dict[str, Relation]) -> tuple[Relation, dict[X.Expr, Typed]]:
        flags: dict[X.Expr, Typed] = {}
        for part in conjuncts(where):
            negated = isinstance(part, X.Unary) and part.op == "not"
            inner = part.arg if negated else part
            if isinstance(inner, X.InQuery):
                relation = self.membership(relation, inner, negated, env, flags)
                continue
            if isinstance(inner, X.Exists):
                relation = self.existence(relation, inner, negated, env)
                continue
            for node in walk(part):
                if isinstance(node, (X.InQuery, X.Exists)) and node not in flags:
                    relation, flags[node] = (self.flag_in if isinstance(node, X.InQuery) else self.flag_exists)(relation, node, env, flags)
            bound = self.expr(part, Scope(relation, flags, where=True))
            if bound.kind not in (Kind.BOOL, Kind.NULL):
                raise SqlError(f"WHERE takes conditions, and this is {bound.kind.value}", part.span, "a comparison makes a condition of it")
            relation = replace(relation, df=relation.df.where(bound.to(Kind.BOOL)))
        return relation, flags

    def keys_of(self, relation: Relation, node: X.InQuery, env: dict[str, Relation], flags: dict[X.Expr, Typed]) -> tuple[list[SparkColumn], DataFrame, list[str]]:
        """The outer keys, and the distinct rows of the inner query under column names of their own."""
        found = self.derive(node.query, env).named("")
        inner = found.visible()
        if len(inner) != len(node.keys):
            raise SqlError(f"{len(node.keys)} before IN cannot be looked up in {len(inner)} columns", node.span)
        outer, columns, names = [], [], []
        for key, field in zip(node.keys, inner, strict=True):
            bound = self.expr(key, Scope(relation, flags, where=True))
            kind = common([bound.kind, field.kind])
            if kind is None:
                raise SqlError(f"this is {bound.kind.value}, and the query gives {field.kind.value}", key.span)
            kind = Kind.INT if kind is Kind.NULL else kind
            outer.append(bound.to(kind))
            names.append(fresh())
            columns.append(field.typed().to(kind).alias(names[-1]))
        return outer, found.df.select(columns).distinct(), names

    def membership(self, relation: Relation, node: X.InQuery, negated: bool, env: dict[str, Relation], flags: dict[X.Expr, Typed]) -> Relation:
        outer, keys, names = self.keys_of(relation, node, env, flags)
        equal = _all([o == F.col(n) for o, n in zip(outer, names, strict=True)])
        if not negated:
            return replace(relation, df=relation.df.join(keys, equal, "left_semi"))
        # rows without NULLs meet by equality; a pair with a NULL on either side may be equal
        gaps = _any([F.col(n).isNull() for n in names])
        open_ = _any([o.isNull() for o in outer])
        df = relation.df.join(keys, equal, "left_anti")
        if len(names) == 1:
            totals = keys.agg(F.count(F.lit(1)).alias(n := fresh()), F.count(F.when(gaps, 1)).alias(g := fresh()))
            df = df.crossJoin(F.broadcast(totals)).where((F.col(n) == 0) | (~open_ & (F.col(g) == 0))).drop(n, g)
        else:
            df = self.without_maybe(df, keys, outer, names)
        return replace(relation, df=df)

    @staticmethod
    def without_maybe(df: DataFrame, keys: DataFrame, outer: list[SparkColumn], names: list[str]) -> DataFrame:
        """The rows whose values of several columns, some of them NULL, equal no key for certain or maybe.

        A row and a key may be equal if they are in the columns where both have values. So for each set of columns that keys have values
        in, rows go by equality of those of them that they have values in: one anti join for each choice, none of them a nested loop.
        """
        asked, has = [fresh() for _ in names], fresh()
        df = df.withColumns(dict(zip(asked, outer, strict=True)))
        pattern = lambda columns: F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns))
        there = [r[0] for r in keys.select(pattern(names).alias(has)).distinct().collect()]  # 2 to the number of columns at most
        for one in sorted(there):
            for mask in range(1 << len(names)):
                mine = f"{mask:0{len(names)}b}"
                if one == mine == "1" * len(names):
                    continue  # equal for certain, and gone already
                both = [i for i in range(len(names)) if one[i] == mine[i] == "1"]
                some = keys.where(pattern(names) == one)
                if both:
                    taken = [fresh() for _ in both]
                    some = some.select(*(F.col(names[i]).alias(t) for i, t in zip(both, taken, strict=True))).distinct()
                    match = _all([pattern(asked) == mine, *(F.col(asked[i]) == F.col(t) for i, t in zip(both, taken, strict=True))])
                    df = df.join(some, match, "left_anti")
                else:  # every such row may be equal to every such key, of which there is one at least
                    df = df.where(pattern(asked) != mine)
        return df.drop(*asked)

    def flag_in(self, relation: Relation, node: X.InQuery, env: dict[str, Relation], flags: dict[X.Expr, Typed]) -> tuple[Relation, Typed]:
        """IN as a value of three: a column beside the rows."""
        outer, keys, names = self.keys_of(relation, node, env, flags)
        mark, n, g = fresh(), fresh(), fresh()
        totals = keys.agg(F.count(F.lit(1)).alias(n), F.count(F.when(_any([F.col(x).isNull() for x in names]), 1)).alias(g))
        df = relation.df.join(keys.withColumn(mark, F.lit(True)), _all([o == F.col(x) for o, x in zip(outer, names, strict=True)]), "left").crossJoin(F.broadcast(totals))
        value = F.when(F.col(n) == 0, False).when(F.col(mark), True).when(_any([o.isNull() for o in outer]) | (F.col(g) > 0), F.lit(None).cast("boolean")).otherwise(False)
        return self.with_flag(relation, df, value)

    @staticmethod
    def with_flag(relation: Relation, df: DataFrame, value: SparkColumn) -> tuple[Relation, Typed]:
        name = fresh()
        keep = [c for c in relation.df.columns]
        return replace(relation, df=df.select(*keep, value.alias(name))), Typed(F.col(name), Kind.BOOL)

    def correlated(self, relation: Relation, node: X.Exists, env: dict[str, Relation]) -> tuple[list[SparkColumn], DataFrame, list[str]]:
        """The equalities with outer columns taken out of an EXISTS query, and the rest of it as distinct keys."""
        query, inner_env = node.query, dict(env)
        for name, part in query.ctes:
            inner_env[name] = self.derive(part, inner_env)
        inner = self.source(query.source, inner_env)
        for join in query.joins:
            inner = self.join(inner, join, inner_env)
        outer_tables = relation.tables() - inner.tables()
        is_outer = lambda c: isinstance(c, X.Column) and c.table is not None and c.table in outer_tables
        pairs, rest = [], []
        for part in conjuncts(query.where):
            if isinstance(part, X.Binary) and part.op == "=" and is_outer(part.left) != is_outer(part.right):
                pairs.append((part.left, part.right) if is_outer(part.left) else (part.right, part.left))
            elif any(is_outer(x) for x in walk(part)):
                raise SqlError("within EXISTS, the outer query's columns are compared by = alone, outside any OR", part.span)
            else:
                rest.append(part)
        for part in rest:
            inner, _ = self.filtered(inner, part, inner_env)
        outer, columns, names = [], [], []
        for a, b in pairs:
            x, y = self.expr(a, Scope(relation, {}, where=True)), self.expr(b, Scope(inner, {}, where=True))
            kind = common([x.kind, y.kind])
            if kind is None:
                raise SqlError(f"this is {y.kind.value}, and the outer column is {x.kind.value}", b.span)
            outer.append(x.to(kind))
            names.append(fresh())
            columns.append(y.to(kind).alias(names[-1]))
        return outer, (inner.df.select(columns).distinct() if columns else inner.df.select(F.lit(1).alias(fresh()))), names

    def existence(self, relation: Relation, node: X.Exists, negated: bool, env: dict[str, Relation]) -> Relation:
        outer, keys, names = self.correlated(relation, node, env)
        if not names:
            holds = bool(keys.limit(1).count()) != negated
            return relation if holds else replace(relation, df=relation.df.where(F.lit(False)))
        equal = _all([o == F.col(n) for o, n in zip(outer, names, strict=True)])
        return replace(relation, df=relation.df.join(keys, equal, "left_anti" if negated else "left_semi"))

    def flag_exists(self, relation: Relation, node: X.Exists, env: dict[str, Relation], flags: dict[X.Expr, Typed]) -> tuple[Relation, Typed]:
        outer, keys, names = self.correlated(relation, node, env)
        if not names:
            return relation, literal(bool(keys.limit(1).count()))
        mark = fresh()
        df = relation.df.join(keys.withColumn(mark, F.lit(True)), _all([o == F.col(n) for o, n in zip(outer, names, strict=True)]), "left")
        return self.with_flag(relation, df, F.col(mark).isNotNull())

    # select lists

    @staticmethod
    def expanded(items: tuple[X.Item, ...], relation: Relation) -> list[X.Item]:
        out = []
        for item in items:
            if isinstance(item.expr, X.Star):
                out += [X.Item(X.Column(item.expr.span, f.name), f.name) for f in relation.visible()]
            else:
                out.append(item)
        return out

    @staticmethod
    def name_of(item: X.Item, i: int) -> str:
        if item.alias:
            return item.alias
        if isinstance(item.expr, X.Column):
            return item.expr.name
        return item.expr.name if isinstance(item.expr, X.Call) else f"column{i + 1}"

    def target(self, e: X.Expr, items: list[X.Item], relation: Relation, what: str, columns_first: bool) -> X.Expr:
        """The expression that a position or an alias stands for."""
        if isinstance(e, X.Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
            if not 1 <= e.value <= len(items):
                raise SqlError(f"{what} counts the selected values, of which number {e.value} is none", e.span, f"there are {len(items)}")
            return items[e.value - 1].expr
        if isinstance(e, X.Column) and e.table is None and not (columns_first and relation.find(e.name)):
            for item in items:
                if item.alias == e.name:
                    return item.expr
        return e

    def plain(self, query: X.Query, items: list[X.Item], relation: Relation, flags: dict[X.Expr, Typed]) -> Relation:
        scope = Scope(relation, flags)
        bound = [self.expr(i.expr, scope) for i in items]
        order = [(self.expr(self.target(o.expr, items, relation, "ORDER BY", False), scope), o.descending) for o in query.order_by]
        return self.finish(query, items, bound, order, lambda columns: relation.df.select(columns), relation)

    def grouped(self, query: X.Query, items: list[X.Item], relation: Relation, flags: dict[X.Expr, Typed]) -> Relation:
        keys = []
        for e in query.group_by:
            key = self.target(e, items, relation, "GROUP BY", True)
            if has_aggregate(key):
                raise SqlError("this is an aggregate, which has a value only once there are groups", e.span)
            keys.append(key)
        plain = Scope(relation, flags)
        columns = [self.expr(k, plain) for k in keys]
        scope = Scope(relation, flags, grouped=[self.normalized(k, relation) for k in keys])
        bound = [self.expr(i.expr, scope) for i in items]
        order = [(self.expr(self.target(o.expr, items, relation, "ORDER BY", False), scope), o.descending) for o in query.order_by]
        by = [c.col.alias(fresh()) for c in columns]

        def build(wanted: list[SparkColumn]) -> DataFrame:
            names = [fresh() for _ in wanted]
            frame = relation.df.groupBy(*by).agg(*(w.alias(n) for w, n in zip(wanted, names, strict=True)))
            return frame.select(*(F.col(n) for n in names))

        return self.finish(query, items, bound, order, build, relation)

    def finish(self, query: X.Query, items: list[X.Item], bound: list[Typed], order: list[tuple[Typed, bool]], build: Callable[[list[SparkColumn]], DataFrame], relation: Relation) -> Relation:
        hidden = [o for o in order if not any(o[0] is b for b in bound)]
        df = build([b.col for b in (*bound, *(h[0] for h in hidden))])
        inner = [fresh() for _ in range(len(bound) + len(hidden))]
        df = df.toDF(*inner)
        if order:
            places = {id(b): n for b, n in zip((*bound, *(h[0] for h in hidden)), inner, strict=True)}
            df = df.orderBy(*(F.col(places[id(o)]).desc() if down else F.col(places[id(o)]).asc() for o, down in order))
        if query.offset:
            df = df.offset(query.offset)
        if query.limit is not None:
            df = df.limit(query.limit)
        df = df.select(*inner[: len(bound)])
        fields = []
        for i, (item, b) in enumerate(zip(items, bound, strict=True)):
            fields.append(Field(self.name_of(item, i), inner[i], b.kind, own=self.name_of(item, i)))
        return Relation(df, tuple(fields), f"[{replace(query, ctes=())!r} of {relation.key}]")

    # expressions

    def normalized(self, e: X.Expr, relation: Relation) -> X.Expr:
        if isinstance(e, X.Column):
            f = relation.find(e.name, e.table)
            return X.Column(e.span, f.inner) if f else e
        if isinstance(e, X.Unary):
            return replace(e, arg=self.normalized(e.arg, relation))
        if isinstance(e, X.Binary):
            return replace(e, left=self.normalized(e.left, relation), right=self.normalized(e.right, relation))
        if isinstance(e, X.Call):
            return replace(e, args=tuple(self.normalized(a, relation) for a in e.args))
        return e

    @staticmethod
    def unknown(name: str, relation: Relation, span: Span) -> None:
        near = suggestion(name, [f.name for f in relation.visible()])
        raise SqlError(f"there is no column {name}", span, nearest(near))

    def expr(self, e: X.Expr, scope: Scope) -> Typed:
        if e in scope.flags:
            return scope.flags[e]
        if scope.grouped is not None and not scope.in_aggregate and self.normalized(e, scope.relation) in scope.grouped:
            return self.expr(e, replace(scope, grouped=None))
        if isinstance(e, X.Literal):
            return literal(e.value)
        if isinstance(e, X.Column):
            f = scope.relation.find(e.name, e.table)
            if f is None:
                if e.table is not None and e.table not in scope.relation.tables():
                    raise SqlError(f"there is no table {e.table} here", e.span)
                self.unknown(e.name, scope.relation, e.span)
            if scope.grouped is not None and not scope.in_aggregate:
                raise SqlError(f"a group has many values of {e.name}", e.span, "an aggregate makes one of them, or GROUP BY makes it part of the key")
            return f.typed()
        if isinstance(e, X.Unary):
            arg = self.expr(e.arg, scope)
            if e.op == "not":
                self.need(arg, (Kind.BOOL,), "NOT takes a condition", e.arg.span)
                return Typed(~arg.to(Kind.BOOL), Kind.BOOL)
            self.need(arg, (Kind.INT, Kind.FLOAT, Kind.DATE, Kind.TIMESTAMP), "a sign takes a number", e.arg.span)
            return S.negative(arg)
        if isinstance(e, X.Binary):
            return self.binary(e, scope)
        if isinstance(e, X.Call):
            return self.call(e, scope)
        if isinstance(e, X.Star):
            raise SqlError("* is for all columns of a SELECT, or for count(*)", e.span)
        if isinstance(e, X.Row):
            raise SqlError("several values side by side go with IN alone", e.span)
        raise SqlError("IN and EXISTS take queries in WHERE alone", e.span)

    @staticmethod
    def need(arg: Typed, kinds: tuple[Kind, ...], message: str, span: Span, hint: str | None = None) -> None:
        if arg.kind is not Kind.NULL and arg.kind not in kinds:
            raise SqlError(f"{message}, and this is {arg.kind.value}", span, hint)

    def binary(self, e: X.Binary, scope: Scope) -> Typed:
        a, b = self.expr(e.left, scope), self.expr(e.right, scope)
        if e.op in ("and", "or"):
            for side, node in ((a, e.left), (b, e.right)):
                self.need(side, (Kind.BOOL,), f"{e.op.upper()} takes conditions", node.span)
            x, y = a.to(Kind.BOOL), b.to(Kind.BOOL)
            return Typed(x & y if e.op == "and" else x | y, Kind.BOOL)
        if e.op in ("+", "-", "*", "/", "%"):
            for side, node in ((a, e.left), (b, e.right)):
                self.need(side, (Kind.INT, Kind.FLOAT, Kind.DATE, Kind.TIMESTAMP), f"{e.op} takes numbers", node.span, "|| puts texts together" if e.op == "+" else None)
            return S.arithmetic(e.op, a, b)
        if common([a.kind, b.kind]) is None:
            hint = None
            if {a.kind, b.kind} & {Kind.DATE, Kind.TIMESTAMP} and Kind.TEXT in (a.kind, b.kind):
                hint = "date() and timestamp() make dates of texts"
            raise SqlError(f"{a.kind.value} and {b.kind.value} do not compare", e.span, hint)
        return S.compare(e.op, a, b)

    def call(self, e: X.Call, scope: Scope) -> Typed:
        function = FUNCTIONS.get(e.name)
        if function is None or e.name in INTERNAL:
            own = self.catalog.function(e.name)
            if own is None:
                known = [*FUNCTIONS, *self.catalog.function_names()]
                near = suggestion(e.name, known)
                raise SqlError(f"there is no function {e.name}", e.span, nearest(near))
            args = [self.expr(a, scope) for a in e.args]
            return own.bind(args, [a.span for a in e.args], e.span)
        if e.name == "count" and len(e.args) == 1 and isinstance(e.args[0], X.Star):
            self.aggregate_allowed(e, scope)
            return A.count_all()
        if not function.least <= len(e.args) <= (len(e.args) if function.most is None else function.most):
            raise SqlError(f"{e.name}() has {function.arity} for its number of arguments, not {len(e.args)}", e.span)
        inner = scope
        if function.aggregate:
            self.aggregate_allowed(e, scope)
            inner = replace(scope, in_aggregate=True)
        args = [self.expr(a, inner) for a in e.args]
        for i, (arg, node) in enumerate(zip(args, e.args, strict=True)):
            wanted = function.param(i)
            if e.name == "case":
                wanted = (Kind.BOOL,) if i % 2 == 0 and i < len(args) - 1 else tuple(Kind)
            if arg.kind is not Kind.NULL and arg.kind not in wanted:
                noun = {"int": "a number", "text": "text", "bool": "a condition", "date": "a date or timestamp", "timestamp": "a timestamp"}[wanted[0].value]
                raise SqlError(f"argument {i + 1} of {e.name}() is {noun}, and this is {arg.kind.value}", node.span)
        if function.alike and common([a.kind for a in args]) is None:
            hint = "date() makes dates of texts" if any(a.kind.temporal for a in args) else None
            raise SqlError(f"{e.name}() compares its arguments, and {' and '.join(dict.fromkeys(a.kind.value for a in args))} do not compare", e.span, hint)
        if e.name in ("case", "if", "coalesce", "ifnull"):
            values = [a for i, a in enumerate(args) if e.name in ("coalesce", "ifnull") or i % 2 or i == len(args) - 1]
            if common([v.kind for v in values]) is None:
                raise SqlError(f"{e.name} has one kind of value, not {' and '.join(dict.fromkeys(v.kind.value for v in values))}", e.span)
        if e.name == "group_concat" and len(args) > 1 and not isinstance(args[1].value, str):
            raise SqlError("what group_concat() puts between values is a text written out", e.args[1].span)
        if e.name == "strftime" and not isinstance(args[0].value, str):
            raise SqlError("the pattern of strftime() is a text written out", e.args[0].span)
        return function.build(*args)

    @staticmethod
    def aggregate_allowed(e: X.Call, scope: Scope) -> None:
        if scope.where:
            raise SqlError(f"WHERE picks rows before {e.name}() sums them up", e.span, "name the grouped query in a WITH and put a WHERE on it")
        if scope.in_aggregate:
            raise SqlError(f"{e.name}() stands inside another aggregate", e.span)
        if scope.grouped is None:
            raise SqlError(f"there are no groups here for {e.name}()", e.span)


def _all(parts: list[SparkColumn]) -> SparkColumn:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts: list[SparkColumn]) -> SparkColumn:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def is_unique(df: DataFrame, keys: list[str]) -> bool:
    """Whether no two rows share a key; NULL keys match nothing and do not count."""
    rows = df.select(*keys).dropna("any").groupBy(*keys).count().where("count > 1")
    return not rows.limit(1).count()

