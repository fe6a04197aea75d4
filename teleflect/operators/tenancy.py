"""Tables that show a tenant its own rows: owners as SQL functions, and a secured view over every table.

A table's owner is reached by following keys: its column names a row of another table, that row's column the next, until
a column that is the tenant. Each table with a key gets a function from it to the tenant; every secured view keeps the
rows whose way leads to the tenant in a session variable, by a semi join. Shared tables have no owner and are seen by any tenant. Where the
variable is not set, no view shows a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Owner:
    """How a table finds its tenant. column: its own column that leads on; to: the table whose key that is (None: the column is the tenant). key: the table's own key, by which others lead here."""

    column: str
    to: str | None = None
    key: str | None = None


VARIABLE = "current_tenant"


def way(table: str, owners: dict[str, Owner]) -> list[str]:
    """Tables from this one to the one that holds the tenant; raises if keys lead in a circle or nowhere."""
    out = [table]
    while (to := owners[out[-1]].to) is not None:
        if to in out or to not in owners or owners[to].key is None:
            raise ValueError(f"{' -> '.join([*out, to])} leads to no tenant")
        out.append(to)
    return out


def secure(spark: SparkSession, tables: dict[str, DataFrame], owners: dict[str, Owner], shared: tuple[str, ...] = (), prefix: str = "secured_") -> list[str]:
    """Temporary views prefix + name of all tables, functions owner_of_<table>(key), and the variable; names of the views. A table that is neither owned nor shared is an error, so none is forgotten."""
    forgotten = set(tables) - set(owners) - set(shared)
    if forgotten:
        raise ValueError(f"no owner for {sorted(forgotten)}")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    for name, df in tables.items():
        df.createOrReplaceTempView(f"base_{name}")

    def joined(name: str) -> tuple[str, str]:
        """FROM clause of a table and all that it leads to, and the column that is the tenant."""
        steps = way(name, owners)
        joins = [f"JOIN base_{b} ON base_{a}.{owners[a].column} = base_{b}.{owners[b].key}" for a, b in zip(steps, steps[1:], strict=False)]
        return " ".join([f"base_{name}", *joins]), f"CAST(base_{steps[-1]}.{owners[steps[-1]].column} AS STRING)"

    views = []
    for name in tables:
        own = owners.get(name)
        if own is None:
            holds = f"{VARIABLE} IS NOT NULL"
        elif own.to is None:
            holds = f"CAST({own.column} AS STRING) = {VARIABLE}"
        else:  # a semi join with the owners' keys
            source, tenant = joined(own.to)
            holds = f"{own.column} IN (SELECT base_{own.to}.{owners[own.to].key} FROM {source} WHERE {tenant} = {VARIABLE})"
        if own is not None and own.key is not None:
            source, tenant = joined(name)
            kind = tables[name].schema[own.key].dataType.simpleString()
            # keys are unique, so the aggregate takes the only row; without one the owner is null
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION owner_of_{name}(wanted {kind}) RETURNS STRING RETURN (SELECT max({tenant}) FROM {source} WHERE base_{name}.{own.key} = wanted)")
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {prefix}{name} AS SELECT * FROM base_{name} WHERE {holds}")
        views.append(f"{prefix}{name}")
    return views


def as_tenant(spark: SparkSession, tenant: str | None) -> None:
    """From now on the session's secured views show this tenant's rows; None: none."""
    spark.sql(f"SET VAR {VARIABLE} = :tenant", args={"tenant": tenant}) if tenant is not None else spark.sql(f"SET VAR {VARIABLE} = NULL")
