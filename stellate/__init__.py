"""A vector analytics engine whose every operator is a lazy DataFrame plan."""

__version__ = "0.1.0"
