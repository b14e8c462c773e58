"""The keyed job state machine, as a batch plan and as a stream."""
