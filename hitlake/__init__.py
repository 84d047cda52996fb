"""Access-log analytics as Spark DataFrame transformations."""
