"""All registered queries."""

from . import evidence, lifecycle, matrix, pictures, quality, templates  # noqa: F401
from .base import COVERS, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "COVERS"]
