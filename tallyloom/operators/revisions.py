"""Revisions of tables' schemas: a graph by predecessor, applied once each and in order, over DataFrames or old Parquet files."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: dict[str, str]
    defaults: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class AddColumn:
    """A column whose rows so far get ``default``; later inserts too, until the default is altered."""

    table: str
    column: str
    kind: str
    default: object = None


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class AlterDefault:
    """What inserts get from now on; rows so far stay."""

    table: str
    column: str
    default: object = None


@dataclass(frozen=True)
class Backfill:
    """Rows that hold null get the value of a SQL expression."""

    table: str
    column: str
    expression: str


Change = CreateTable | AddColumn | DropColumn | AlterDefault | Backfill


@dataclass(frozen=True)
class Revision:
    id: str
    after: tuple[str, ...]
    changes: tuple[Change, ...]


def in_order(revisions: list[Revision]) -> list[Revision]:
    """The revisions, each after its predecessors (several may follow one); an unknown predecessor, a circle or an id used twice is refused."""
    by_id = {r.id: r for r in revisions}
    if len(by_id) < len(revisions):
        raise ValueError("an id is used twice")
    for r in revisions:
        if unknown := set(r.after) - set(by_id):
            raise ValueError(f"revision {r.id} follows {sorted(unknown)}, which is not there")
    sorter = TopologicalSorter({i: set(by_id[i].after) for i in sorted(by_id)})
    try:
        return [by_id[i] for i in sorter.static_order()]
    except CycleError as e:
        raise ValueError(f"revisions in a circle: {' -> '.join(e.args[1])}") from None


def _value(default: object, kind: str) -> Column:
    return F.lit(default).cast(kind)


def _change(spark: SparkSession, tables: dict[str, DataFrame], c: Change) -> None:
    if isinstance(c, CreateTable):
        if c.table not in tables:
            tables[c.table] = spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in c.columns.items()))
        return
    t = tables.get(c.table)
    if t is None:
        raise ValueError(f"there is no table {c.table}")
    if isinstance(c, AddColumn):
        tables[c.table] = t if c.column in t.columns else t.withColumn(c.column, _value(c.default, c.kind))
    elif isinstance(c, DropColumn):
        tables[c.table] = t.drop(c.column)
    elif isinstance(c, Backfill):
        tables[c.table] = t.withColumn(c.column, F.coalesce(F.col(c.column), F.expr(c.expression)))


def upgrade(spark: SparkSession, tables: dict[str, DataFrame], versions: DataFrame, revisions: list[Revision]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and versions (one column, ``version``) after all revisions that are not among the versions, in order.

    A revision is applied once; a column that is there already stays as it is.
    """
    done = {r["version"] for r in versions.select("version").distinct().collect()}  # no more than there are revisions
    after, new = dict(tables), []
    for r in in_order(revisions):
        if r.id in done:
            continue
        for c in r.changes:
            _change(spark, after, c)
        done.add(r.id)
        new.append((r.id,))
    return after, versions.select("version").union(spark.createDataFrame(new, "version string"))


def downgrade(tables: dict[str, DataFrame], versions: DataFrame, revisions: list[Revision], to: str | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and versions after everything applied later than ``to`` is taken back, the last first; what a dropped column held is not known any more."""
    order = in_order(revisions)
    keep = set() if to is None else {r.id for r in order[: [r.id for r in order].index(to) + 1]}
    done = {r["version"] for r in versions.select("version").distinct().collect()}
    kinds = {(c.table, n): k for r in order for c in r.changes if isinstance(c, (CreateTable, AddColumn)) for n, k in (c.columns.items() if isinstance(c, CreateTable) else [(c.column, c.kind)])}
    after = dict(tables)
    for r in reversed([r for r in order if r.id in done - keep]):
        for c in reversed(r.changes):
            if isinstance(c, CreateTable):
                after.pop(c.table, None)
            elif isinstance(c, AddColumn):
                after[c.table] = after[c.table].drop(c.column)
            elif isinstance(c, DropColumn):
                after[c.table] = after[c.table].withColumn(c.column, F.lit(None).cast(kinds[c.table, c.column]))
    return after, versions.where(F.col("version").isin(sorted(done & keep)) if done & keep else F.lit(False))


def read_parts(parts: list[tuple[DataFrame, str]], table: str, revisions: list[Revision]) -> DataFrame:
    """A table kept in parts that were written at different revisions, as of the last: (part, the last revision applied before it was written).

    Each part is read with its own columns and gets those added since with the default they were added
    with; a column dropped since goes from it. Nothing is written again.
    """
    order = in_order(revisions)
    at = {r.id: i for i, r in enumerate(order)}
    out = None
    for part, version in parts:
        held = {table: part}
        for r in order[at[version] + 1 :]:
            for c in r.changes:
                if c.table == table and not isinstance(c, CreateTable):
                    _change(part.sparkSession, held, c)
        out = held[table] if out is None else out.unionByName(held[table])
    return out


def defaults_at(revisions: list[Revision], table: str) -> dict[str, tuple[object, str | None]]:
    """Each column's default for inserts after all revisions, with its type where a revision gave one."""
    found: dict[str, tuple[object, str | None]] = {}
    for r in in_order(revisions):
        for c in r.changes:
            if c.table != table:
                continue
            if isinstance(c, CreateTable):
                found = {n: (c.defaults.get(n), k) for n, k in c.columns.items()}
            elif isinstance(c, AddColumn):
                found.setdefault(c.column, (c.default, c.kind))
            elif isinstance(c, AlterDefault):
                found[c.column] = (c.default, found.get(c.column, (None, None))[1])
            elif isinstance(c, DropColumn):
                found.pop(c.column, None)
    return found


def insert(table: DataFrame, rows: DataFrame, revisions: list[Revision], name: str) -> DataFrame:
    """The table with more rows; columns they lack get their present default."""
    defaults = defaults_at(revisions, name)
    kinds = dict(table.dtypes)
    more = {c: _value(defaults.get(c, (None, None))[0], kinds[c]) for c in table.columns if c not in rows.columns}
    return table.unionByName(rows.withColumns(more).select(*table.columns))
