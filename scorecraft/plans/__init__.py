"""Query bindings over the driver tables and their DuckDB oracles."""

from scorecraft.plans.registry import REGISTRY, Query, register, table


def load_all() -> dict:
    """Import every binding module so that its queries register."""
    import importlib
    for mod in ("metric_queries", "vector_queries", "text_queries", "io_queries", "eval_queries"):
        try:
            importlib.import_module(f"scorecraft.plans.{mod}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"scorecraft.plans.{mod}":
                raise
    return REGISTRY


__all__ = ["REGISTRY", "Query", "register", "table", "load_all"]
