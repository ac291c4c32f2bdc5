"""All registered queries."""

from conformance import assembly, columns, searching  # noqa: F401
from conformance.registry import CASES

__all__ = ["CASES"]
