"""Named queries over the driver tables, each with the SQL that states the same result."""

from . import core, features, risk, sources, spatial


def queries() -> dict:
    return {n: f for m in (core, spatial, features, risk, sources) for n, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in (core, spatial, features, risk, sources) for n, s in m.SQL.items()}
