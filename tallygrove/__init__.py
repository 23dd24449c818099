"""Credit, market and tabular analytics as Spark DataFrame operators."""
