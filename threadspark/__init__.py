"""threadspark: DataFrame operators for threaded discussion data on Apache Spark.

Every public operator is a plain function that takes and returns Spark
DataFrames (or Columns for scalar functions), so Catalyst can optimise the
whole pipeline as one logical plan.
"""

__version__ = "0.1.0"
