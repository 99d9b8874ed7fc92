"""Graph analytics for software-architecture property graphs, as Spark DataFrame plans."""
