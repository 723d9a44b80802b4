"""Semantic requests as DataFrames: a declared model of datasets, fields, metrics and many-to-one relationships.

A request names metrics, measures, dimensions, filters, order and limit. It becomes one plan: the fact, inner joins
along the shortest relationship chains, filters, one aggregation. Dimension tables are projected to the fields asked
for before they are joined, and Catalyst takes it from there (pushdown, pruning, join strategy by measured size).
"""

from __future__ import annotations

import datetime
import numbers
import re
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", "<>", ">", ">=", "<", "<=", "in", "not in", "between", "like", "is null", "is not null")
AGGREGATES = ("sum", "avg", "min", "max", "count", "count_distinct")


class RequestError(ValueError):
    """A request that the model can't answer."""


class FilterTypeError(RequestError):
    """A filter value that doesn't fit its field's type."""


@dataclass(frozen=True)
class Field:
    dataset: str
    name: str
    expression: str
    kind: str  # integer, number, string, date, timestamp or boolean


@dataclass(frozen=True)
class Relationship:
    """Each row of `many` has one row of `one`, equal on the column pairs."""

    name: str
    many: str
    one: str
    on: tuple[tuple[str, str], ...]
    default: bool = False  # the one to take of several between its two datasets


@dataclass(frozen=True)
class Metric:
    name: str
    dataset: str
    expression: str


@dataclass(frozen=True)
class Measure:
    field: str
    agg: str = "sum"
    alias: str | None = None


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Request:
    metrics: Sequence[str] = ()
    measures: Sequence[Measure] = ()
    dimensions: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    order_by: Sequence[str] = ()
    limit: int | None = None
    fact: str | None = None
    via: Mapping[str, str] = field(default_factory=dict)  # dataset to the relationship that must reach it
    allow_fan_out: bool = False


def slug(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()


def typed(f: Field, value: object) -> object:
    """The value as the field's type has it, or an error that says what is expected."""
    wrong = FilterTypeError(f"{f.dataset}.{f.name} is of type {f.kind}; {value!r} doesn't fit it")
    try:
        if f.kind == "integer":
            if isinstance(value, bool) or (isinstance(value, float) and value != int(value)):
                raise wrong
            return int(value)
        if f.kind == "number":
            if isinstance(value, bool) or not isinstance(value, (numbers.Number, str)):
                raise wrong
            return float(value)
        if f.kind == "date":
            return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value))
        if f.kind == "timestamp":
            return value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
        if f.kind == "boolean":
            if not isinstance(value, bool):
                raise wrong
            return value
    except (TypeError, ValueError) as e:
        raise wrong from e
    if not isinstance(value, str):
        raise wrong
    return value


def condition(column: Column, f: Field, flt: Filter) -> Column:
    op = flt.op.lower()
    if op not in OPERATORS:
        raise RequestError(f"unknown operator {flt.op!r}; known: {', '.join(OPERATORS)}")
    if op == "is null":
        return column.isNull()
    if op == "is not null":
        return column.isNotNull()
    if op in ("in", "not in"):
        values = flt.value if isinstance(flt.value, (list, tuple, set)) else [flt.value]
        # a null in the list makes `not in` unknown for every row, as SQL has it
        found = column.isin([None if v is None else typed(f, v) for v in values])
        return found if op == "in" else ~found
    if op == "between":
        if not isinstance(flt.value, (list, tuple)) or len(flt.value) != 2:
            raise RequestError(f"between needs two values, not {flt.value!r}")
        return column.between(*(typed(f, v) for v in flt.value))
    if op == "like":
        if f.kind != "string":
            raise FilterTypeError(f"like needs a string field; {f.dataset}.{f.name} is of type {f.kind}")
        return column.like(typed(f, flt.value))
    value = F.lit(typed(f, flt.value))
    return {"=": column == value, "!=": column != value, "<>": column != value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]


class SemanticModel:
    def __init__(self, datasets: Sequence[str], fields: Sequence[Field], metrics: Sequence[Metric], relationships: Sequence[Relationship]):
        self.datasets = tuple(datasets)
        self.fields = {f"{f.dataset}.{f.name}": f for f in fields}
        self.metrics = {m.name: m for m in metrics}
        self.relationships = {r.name: r for r in relationships}

    def problems(self) -> list[str]:
        """What dangles: relationships and fields of unknown datasets, metrics over unknown datasets."""
        out = [f"relationship {r.name}: no dataset {d}" for r in self.relationships.values() for d in (r.many, r.one) if d not in self.datasets]
        out += [f"field {n}: no dataset {f.dataset}" for n, f in self.fields.items() if f.dataset not in self.datasets]
        return out + [f"metric {m.name}: no dataset {m.dataset}" for m in self.metrics.values() if m.dataset not in self.datasets]

    def default_relationship(self, a: str, b: str) -> Relationship | None:
        """The declared default of those between two datasets, else the first by name."""
        between = [r for r in self.relationships.values() if {r.many, r.one} == {a, b}]
        return min(between, key=lambda r: (not r.default, r.name), default=None)

    def join_path(self, start: str, target: str, via: Mapping[str, str] | None = None) -> list[tuple[Relationship, str]]:
        """(relationship, dataset it leads to) along a shortest chain. A pinned dataset is reached by its relationship alone, another one not beside a declared default."""
        via = via or {}
        before: dict[str, tuple[str, Relationship] | None] = {start: None}
        todo = deque([start])
        while todo and target not in before:
            here = todo.popleft()
            for r in sorted(self.relationships.values(), key=lambda r: r.name):
                if here not in (r.many, r.one):
                    continue
                there = r.one if here == r.many else r.many
                if there in before or (there in via and via[there] != r.name):
                    continue
                chosen = self.default_relationship(here, there)
                if there not in via and chosen.default and not r.default:
                    continue
                before[there] = (here, r)
                todo.append(there)
        if target not in before:
            raise RequestError(f"no chain of relationships from {start} to {target}")
        path, at = [], target
        while before[at] is not None:
            here, r = before[at]
            path.append((r, at))
            at = here
        return path[::-1]

    def fact_of(self, request: Request) -> str:
        owners = [self._metric(m).dataset for m in request.metrics] + [self.field(m.field).dataset for m in request.measures]
        if request.fact:
            owners.insert(0, request.fact)
        elif not owners:
            owners = [self.field(d).dataset for d in request.dimensions][:1]
        if not owners:
            raise RequestError("a request needs a metric, a measure or a dimension")
        if len(set(owners)) > 1:
            raise RequestError(f"metrics and measures of several facts: {', '.join(sorted(set(owners)))}")
        return owners[0]

    def field(self, name: str) -> Field:
        if name not in self.fields:
            raise RequestError(f"no field {name}")
        return self.fields[name]

    def _metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise RequestError(f"no metric {name}")
        return self.metrics[name]

    def plan(self, request: Request) -> tuple[str, list[tuple[Relationship, str]]]:
        """The fact and the joins in order, each relationship once."""
        fact = self.fact_of(request)
        needed = dict.fromkeys([self.field(d).dataset for d in request.dimensions] + [self.field(f.field).dataset for f in request.filters])
        steps: dict[str, tuple[Relationship, str]] = {}
        for dataset in needed:
            for r, to in self.join_path(fact, dataset, request.via):
                if to == r.many and not request.allow_fan_out:
                    raise RequestError(f"{r.name} leads from one {r.one} to many {r.many}: rows of {fact} would count several times")
                steps.setdefault(r.name, (r, to))
        return fact, list(steps.values())

    def compile(self, request: Request, tables: Mapping[str, DataFrame]) -> DataFrame:
        fact, steps = self.plan(request)
        asked = [self.field(n) for n in (*request.dimensions, *(f.field for f in request.filters))]
        df = tables[fact]

        def column(f: Field) -> Column:
            return F.expr(f.expression) if f.dataset == fact else F.col(f"`{f.dataset}.{f.name}`")

        def key(dataset: str, name: str) -> Column:
            return F.col(name) if dataset == fact else F.col(f"`{dataset}#{name}`")

        for r, to in steps:
            here = r.one if to == r.many else r.many
            pairs = [(b, a) for a, b in r.on] if to == r.many else list(r.on)
            keys = {b for _, b in pairs} | {a for q, _ in steps for a, b in q.on if q.many == to} | {b for q, _ in steps for a, b in q.on if q.one == to}
            own = {f.name: f for f in asked if f.dataset == to}
            side = tables[to].select(*[F.col(k).alias(f"{to}#{k}") for k in sorted(keys)], *[F.expr(f.expression).alias(f"{to}.{f.name}") for f in own.values()])
            on = [key(here, a) == F.col(f"`{to}#{b}`") for a, b in pairs]
            df = df.join(side, on, "inner")
        for flt in request.filters:
            f = self.field(flt.field)
            df = df.where(condition(column(f), f, flt))
        dims = [column(self.field(d)).alias(self.field(d).name) for d in request.dimensions]
        values = [F.expr(self._metric(m).expression).alias(slug(m)) for m in request.metrics]
        for m in request.measures:
            if m.agg not in AGGREGATES:
                raise RequestError(f"unknown aggregate {m.agg!r}")
            values.append(getattr(F, m.agg)(column(self.field(m.field))).alias(m.alias or f"{m.agg}_{self.field(m.field).name}"))
        df = df.groupBy(*dims).agg(*values) if values else df.select(*dims)
        if request.order_by:
            for name in request.order_by:
                if name.lstrip("-") not in df.columns:
                    raise RequestError(f"order by {name}: not selected")
            df = df.orderBy(*[F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last() for n in request.order_by])
        return df.limit(request.limit) if request.limit else df

    def describe(self) -> list[tuple[str, str, str, str]]:
        """(kind, dataset, name, expression) of all there is."""
        rows = [("field", f.dataset, f.name, f.expression) for f in self.fields.values()] + [("metric", m.dataset, m.name, m.expression) for m in self.metrics.values()]
        return rows + [("relationship", r.many, r.name, " and ".join(f"{a} = {b}" for a, b in r.on)) for r in self.relationships.values()]
