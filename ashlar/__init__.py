"""A Spark-first analytics engine: an OLAP SQL dialect expressed over DataFrames."""
