"""Table analytics expressed as PySpark DataFrame operators."""
