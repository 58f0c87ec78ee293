"""A Spark-first analytics engine: batch, streaming and text operators over DataFrames."""
