"""Search, data-structure and training-data analytics as Spark DataFrame plans."""
