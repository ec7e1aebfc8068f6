"""Column-level building blocks: no DataFrame, no action, no clock."""
