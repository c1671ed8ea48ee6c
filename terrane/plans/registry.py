"""Named queries over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Register a function (spark, folder) under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


from terrane.plans import entity_queries, layer_queries, more_queries, relational_queries, spatial_queries, text_queries, value_queries  # noqa: E402,F401
