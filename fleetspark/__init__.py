"""fleetspark: CI-fleet analytics operators on PySpark DataFrames.

Every operator takes DataFrames (plus plain parameters such as ``as_of``)
and returns a DataFrame built from built-in Spark expressions, joins,
aggregates and windows.  Nothing here collects data to the driver.
"""

__version__ = "0.1.0"
