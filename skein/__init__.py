"""Text-retrieval analytics as Spark DataFrame operators."""
