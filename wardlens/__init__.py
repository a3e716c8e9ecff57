"""wardlens: a Spark-first engine for clinical-text analytics."""

__version__ = "0.1.0"
