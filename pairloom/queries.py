"""All core queries and the SQL that states them for checking."""

from __future__ import annotations

import importlib

from pairloom.query_sets import QUERIES, SQL, Query

for _name in ("evaluation", "nested", "building", "scalars", "sources"):
    importlib.import_module(f"pairloom.query_sets.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
