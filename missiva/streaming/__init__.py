"""streaming of the mail engine."""
