"""News-coverage analytics as Spark DataFrame operations."""

from newsloom.plans.report import build_articles, build_report

__all__ = ["build_articles", "build_report"]
