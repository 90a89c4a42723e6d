"""Retrieval over document corpora as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames. See README.md for a tour.
"""
