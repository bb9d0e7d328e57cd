"""Registered queries: each binds an operator to the driver's tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "scalars", "parsing", "retrieval", "catalog", "graphs", "ladder", "reports", "chats", "syncing", "audits", "streams",
)


def load_all():
    from .registry import REGISTRY

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
