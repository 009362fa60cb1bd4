"""Registered queries over the shared test tables, each with its SQL counterpart where one exists."""

from importlib import import_module

AREAS = (
    "panel_queries", "forecast_queries", "function_queries", "schema_queries", "quality_queries", "readiness_queries",
    "registry_queries", "source_queries", "model_queries",
)


def load():
    """Import every area and return (queries, SQL) by name."""
    for area in AREAS:
        import_module(f"sparkcast.catalog.{area}")
    from sparkcast.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
