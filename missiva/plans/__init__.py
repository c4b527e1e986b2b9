"""plans of the mail engine."""
