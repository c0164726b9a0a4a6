"""A versioned key-value analytics engine on Spark."""
