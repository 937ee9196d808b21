"""Operators: functions from DataFrames to DataFrames, for all symbols, venues and windows at once."""
