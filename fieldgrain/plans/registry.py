"""All registered queries over the engine's own operators."""

from . import composites, images, objects, populations, scores  # noqa: F401  they register
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
