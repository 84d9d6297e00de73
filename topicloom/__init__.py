"""Topic analytics over large text tables, as composable Spark DataFrame steps."""

__version__ = "0.1.0"
