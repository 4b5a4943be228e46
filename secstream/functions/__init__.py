"""secstream.functions."""
