"""What the driver's entry adds when this subpackage is there."""

from tracewell.llm.queries import QUERIES
from tracewell.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
