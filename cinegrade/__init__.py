"""Text-rating analytics on Spark: from raw text collections to rating predictions."""
