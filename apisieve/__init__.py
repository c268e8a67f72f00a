"""apisieve: analytics over Python libraries and their client code, as Spark DataFrame operations."""
