"""sources of the mail engine."""
