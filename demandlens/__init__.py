"""demandlens: demand-vs-coverage analytics as lazy PySpark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazy DataFrame.  Global scalars (year range, provider count, quantiles, min/max)
are scalar subqueries, so no operator collects data to the driver.
"""

from demandlens.session import get_spark, checkpoint_dir, materialize

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
