"""Checks: every operator applied to the given tables, beside the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

#: One module per area of the operator inventory.
AREAS = ("filters", "joins", "aggregates", "windows", "paging", "sets", "scalars", "search", "extraction", "merging", "folds",
         "quality", "streams")


def load_checks():
    from evidex.plans import registry

    for area in AREAS:
        import_module(f"evidex.plans.{area}_checks")
    return registry.CHECKS
