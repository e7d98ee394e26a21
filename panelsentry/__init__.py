"""Panel-series quality control as Spark DataFrame jobs."""
