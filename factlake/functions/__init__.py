"""Text-column jobs built from Spark expressions."""
