"""Copy detection and corpus analytics expressed as PySpark DataFrame plans."""
