"""Code-corpus analytics on PySpark: facts, rollups, graphs, diffs, rules and gates over many repositories at once."""

__version__ = "0.1.0"
