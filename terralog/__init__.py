"""Geographic reference and population data as Spark DataFrames.

Every operator is a function from DataFrame to DataFrame.  Row order matters
in this data ("first match wins", stable sorts), so each table carries a unique
long ordinal column named ``_pos``.
"""

from terralog.names import POS

__all__ = ["POS"]
