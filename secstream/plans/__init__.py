"""secstream.plans."""
