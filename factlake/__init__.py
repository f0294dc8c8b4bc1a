"""factlake: evidence-tracked facts on Spark."""
