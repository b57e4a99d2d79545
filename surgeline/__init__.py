"""surgeline: consumption-anomaly analytics as PySpark DataFrame operators."""
