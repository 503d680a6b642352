"""Customer-campaign analytics as PySpark DataFrame operators."""
