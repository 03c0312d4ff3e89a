"""See the README for what this part of the package holds."""
