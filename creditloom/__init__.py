"""Credit-risk features, scoring, explanation, evaluation and audit as Spark DataFrame jobs."""

__version__ = "0.1.0"
