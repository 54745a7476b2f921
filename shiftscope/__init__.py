"""shiftscope: explain why a business metric changed between two periods, on Spark.

Every operator takes lazy Spark DataFrames and returns a lazy DataFrame; nothing is
collected inside an operator.  See README.md for the layout.
"""

from shiftscope.periods import Periods
from shiftscope.tables import MarketingTables

__all__ = ["Periods", "MarketingTables"]
