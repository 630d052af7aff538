"""heronry: text retrieval, service telemetry and corpus preparation as Spark jobs.

Every operator is a function from DataFrames to a DataFrame.  The plan is
declared with the DataFrame API; Catalyst and AQE choose the physical form.
"""

__version__ = "0.1.0"
