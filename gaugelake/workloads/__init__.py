"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("reporting", "validation", "history", "lakes")


def _registries():
    return [import_module(f"{__name__}.{name}").REGISTRY for name in _MODULES]


def all_queries() -> dict:
    return {name: query for registry in _registries() for name, query in registry.queries.items()}


def all_oracles() -> dict:
    return {name: sql for registry in _registries() for name, sql in registry.oracles.items()}
