"""Analytics queries written on the PySpark DataFrame API."""
