"""The state machine as a stream."""
