"""All registered queries; importing a module of the list registers what it holds."""

from importlib import import_module

from larder.llm.registry import ORACLES, QUERIES

for _module in ("queries_filters", "queries_dedup", "queries_tokens", "queries_mixing", "queries_counts"):
    import_module(f"larder.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
