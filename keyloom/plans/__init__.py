"""Named queries. Importing a module of this package registers its queries."""

from importlib import import_module

_MODULES = ("table_queries", "summary_queries", "mapping_queries", "enrichment_queries", "cluster_queries", "read_queries",
            "model_queries", "source_queries")


def load_all():
    from . import registry
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.SQL
