"""Street-network and corpus analytics expressed as Spark DataFrame plans."""
