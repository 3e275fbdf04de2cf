"""Operators over the code model: functions from DataFrames to DataFrames."""
