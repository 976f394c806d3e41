"""Deletes that follow foreign keys through all tables that refer to what goes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent``'s key; ``action`` is what a parent's deletion does to the child's rows."""

    child: str
    column: str
    parent: str
    action: str = RESTRICT


def deletion_order(tables: Iterable[str], references: Iterable[Reference]) -> list[str]:
    """The tables, each after all that it refers to; references in a circle, of a table to itself too, are refused."""
    graph: dict[str, set[str]] = {t: set() for t in sorted(tables)}
    for r in references:
        graph[r.child].add(r.parent)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"references in a circle: {' -> '.join(e.args[1])}") from None


def deleted_keys(tables: dict[str, DataFrame], gone: dict[str, DataFrame], references: list[Reference], key: str = "id") -> dict[str, DataFrame]:
    """For each table the keys of the rows that go: those in ``gone`` and those whose parents go along cascading references.

    One semi-join an edge, in the order of the references; only keys are read and written.
    """
    found: dict[str, DataFrame] = {}
    for name in deletion_order(tables, references):
        table = tables[name]
        parts = [table.select(key).join(gone[name].select(key).distinct(), key, "left_semi")] if name in gone else []
        for r in references:
            if r.child == name and r.action == CASCADE and r.parent in found:
                parent = found[r.parent].select(F.col(key).alias(r.column))
                parts.append(table.select(key, r.column).join(parent, r.column, "left_semi").select(key))
        if parts:
            keys = parts[0]
            for p in parts[1:]:
                keys = keys.union(p)
            found[name] = cut(keys.distinct(), "gone")
    return found


def delete_with_references(tables: dict[str, DataFrame], gone: dict[str, DataFrame], references: list[Reference], key: str = "id") -> dict[str, DataFrame]:
    """All tables after rows (``gone``: keys by table) are deleted with what refers to them.

    Along a cascading reference children go too, and theirs in turn; along ``set null`` the column becomes
    null; where rows that stay still refer to what went along ``restrict``, the delete is an error and
    nothing follows. Null references refer to nothing; keys that no row has are ignored.
    """
    keys = deleted_keys(tables, gone, references, key)
    out = {}
    for name, table in tables.items():
        rest = table.join(keys[name], key, "left_anti") if name in keys else table
        for r in references:
            if r.child != name or r.parent not in keys or r.action == CASCADE:
                continue
            parent = keys[r.parent].select(F.col(key).alias(r.column))
            if r.action == SET_NULL:
                marked = rest.join(parent.withColumn("_gone", F.lit(True)), r.column, "left")
                rest = marked.withColumn(r.column, F.when(F.col("_gone").isNull(), F.col(r.column))).drop("_gone")
            elif held := rest.join(parent, r.column, "left_semi").select(key).take(1):
                raise ValueError(f"{name} {held[0][0]} still refers to a deleted row of {r.parent} by {r.column}")
        out[name] = rest.select(*table.columns)
    return out
