"""Benchmark analytics as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing in
the operators collects rows; actions happen only in sinks, in the suite runner
and in streaming batches.
"""
