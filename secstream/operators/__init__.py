"""secstream.operators."""
