"""Price intelligence for secondary markets, and training-text preparation, as Spark DataFrame queries."""
