"""secstream.streaming."""
