"""Panel analytics on Spark: relational panel operators, regime models and evaluation."""

__version__ = "0.1.0"
