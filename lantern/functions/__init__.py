"""See the README for the module map."""
