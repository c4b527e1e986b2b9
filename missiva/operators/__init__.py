"""operators of the mail engine."""
