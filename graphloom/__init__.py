"""graphloom: a Spark-native knowledge-graph analytics engine.

Every operator is a function from DataFrames to a DataFrame. Nothing is collected to the driver unless
its size has a stated bound.
"""

__version__ = "0.1.0"
