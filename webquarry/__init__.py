"""Web pages to Markdown and token budgets, as Spark DataFrame jobs."""

from webquarry.options import Options, Rule

__all__ = ["Options", "Rule"]
