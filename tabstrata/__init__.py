"""Stacked multiclass classification over large tables, expressed as Spark jobs."""

__all__ = ["sources", "functions", "operators", "learners", "plans"]
