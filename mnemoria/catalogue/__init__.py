"""Named queries over the driver's tables, each with independent SQL where SQL can express it."""

from .registry import ORACLES, QUERIES
from . import flagship, graphs, lexicals, lives, states, texts, vectors, writes  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
