"""foretide: probabilistic forecasting analytics on Spark."""
