"""Daily-climate analytics as Spark DataFrame jobs.

``functions`` are Column expressions, ``sources`` read and write the data model,
``operators`` are DataFrame -> DataFrame steps, ``streaming`` holds the Structured
Streaming jobs and ``plans`` composes all of them into named queries.
"""
