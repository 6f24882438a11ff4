"""Product-registry analytics and brand resolution as Spark DataFrame operators."""
