"""Column helpers: every function takes and returns ``pyspark.sql.Column``."""
