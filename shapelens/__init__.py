"""shapelens: discover and describe the shape of data with Spark.

Every operator takes DataFrames and returns DataFrames built from Spark SQL
expressions, so Catalyst plans them and the work is spread over the cluster.
"""

__version__ = "0.1.0"
