"""boxloom: region analytics as Spark DataFrame transformations."""
