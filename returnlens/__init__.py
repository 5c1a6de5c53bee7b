"""Return attribution for whole security universes, written as Spark DataFrame operators."""
