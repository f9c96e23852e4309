"""Importing the package fills the registry."""

from . import aggregates, identifiers, joins, matrices, models, numbers, ordering, scans, sequences  # noqa: F401
from .registry import REGISTRY  # noqa: F401
