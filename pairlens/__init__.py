"""pairlens: finds the likely matches that a blocking step discarded, on Spark."""
