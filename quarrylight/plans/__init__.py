"""The registered queries, one module per family."""

from importlib import import_module

MODULES = ["lineage_queries", "search_queries", "run_queries", "quality_queries", "tool_queries", "gold_queries", "audit_queries", "curation_queries", "source_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"quarrylight.plans.{name}")
