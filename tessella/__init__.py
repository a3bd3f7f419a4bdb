"""A faceted analytics engine on PySpark."""
from .engine import Engine

__all__ = ["Engine"]
