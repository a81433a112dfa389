"""All registered queries; importing a module of the list registers what it holds."""

from importlib import import_module

from larder.plans.registry import ORACLES, QUERIES

for _module in ("finding", "reading", "loading", "changing", "tangling", "following"):
    import_module(f"larder.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
