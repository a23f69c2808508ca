"""granary: an analytics engine that declares its plans with the PySpark DataFrame and SQL APIs."""
