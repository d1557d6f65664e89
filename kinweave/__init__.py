"""Spark-native analytic operators: DataFrames in, DataFrames out.

Nothing here defines a UDF. Every operator is a composition of built-in Spark SQL
expressions, so Catalyst sees the whole plan.
"""
