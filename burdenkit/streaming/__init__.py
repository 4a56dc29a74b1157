"""Incremental loading. The model itself has no streams: no event time, windows over time or state."""
