"""KPI analytics as PySpark DataFrame plans."""
