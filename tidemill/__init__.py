"""Event-time analytics on PySpark: DataFrame builders, a SQL script runner and streaming forms of both."""
