"""Whole analyses, and queries over the given tables with their SQL equivalents."""


def load_queries():
    """The registry, filled by importing every module that registers queries."""
    from seasonwin.plans import model_queries, ordered_queries, registry, scan_queries, table_queries  # noqa: F401

    return registry
