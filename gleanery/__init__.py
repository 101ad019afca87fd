"""Knowledge-retrieval analytics as Spark DataFrame operators."""
