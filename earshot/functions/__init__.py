"""Column-level functions: metrics, conversation features and the clock."""
