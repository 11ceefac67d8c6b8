"""Multi-sensor track and sector analytics expressed as Spark plans."""
