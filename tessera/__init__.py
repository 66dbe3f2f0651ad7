"""tessera: business analytics and retrieval operators as Spark DataFrame plans."""
