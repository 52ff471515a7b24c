"""Research-output analytics as Spark DataFrame transformations."""
