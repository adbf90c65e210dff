"""ledgerlake: retail-bank ledger and reporting operators on Spark DataFrames.

Every operator is a plain function over DataFrames (a ``Bank`` snapshot plus
request batches) that returns DataFrames; nothing loops over rows on the
driver.
"""

from ledgerlake.schema import Bank

__all__ = ["Bank"]
