"""Batch jobs for document knowledge bases on Spark DataFrames."""
