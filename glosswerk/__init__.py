"""Citation and claim integrity analytics expressed as Spark DataFrame plans."""
