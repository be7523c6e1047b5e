"""Windows, the state machine, views and metrics."""
