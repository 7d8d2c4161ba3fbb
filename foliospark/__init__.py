"""foliospark: document revision analytics as Spark DataFrame operators."""
