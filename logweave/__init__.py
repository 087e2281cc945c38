"""logweave: Spark-native log mining and failure prediction.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions (and ``pyspark.ml`` estimators for the models).
No operator collects data to the driver; bounds such as the first and last
timestamp enter plans as scalar subqueries.
"""

__version__ = "0.1.0"
