"""Daily analytics over code-hosting activity events, written as plain Spark jobs.

Raw nested JSON events become one flat event table per day, the event table
becomes nine small daily summaries, and the summaries answer dashboard queries.
Every operator is a function from DataFrame to DataFrame.
"""

__version__ = "0.1.0"
