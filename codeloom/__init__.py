"""A PySpark-native engine for code and text intelligence over DataFrames."""
