"""semql: semantic and relational querying of tables on Spark DataFrames."""

__version__ = "0.1.0"
