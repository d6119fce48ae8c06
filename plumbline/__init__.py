"""plumbline: point-in-time evaluation and governance relations on Spark."""
