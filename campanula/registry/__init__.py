"""All registered queries, by survey section."""

from __future__ import annotations

from importlib import import_module

_SECTIONS = ("basics", "joins", "metrics", "business", "dashboards", "audiences", "collections")


def load() -> dict:
    for section in _SECTIONS:
        import_module(f"campanula.registry.{section}")
    from campanula.registry.base import QUERIES

    return QUERIES
