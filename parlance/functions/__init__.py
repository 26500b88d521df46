"""Text utilities and scores, on the driver and as column expressions."""
