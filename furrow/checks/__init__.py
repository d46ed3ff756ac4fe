"""The engine's queries over the given tables and their SQL counterparts."""

from importlib import import_module

AREAS = ("cleaning", "features", "imagery", "sampling", "scoring", "storage", "paths")


def all_checks():
    """(queries, oracles) of every area."""
    from furrow.checks import registry

    for area in AREAS:
        import_module(f"furrow.checks.{area}")
    return registry.QUERIES, registry.ORACLES
