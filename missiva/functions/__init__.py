"""functions of the mail engine."""
