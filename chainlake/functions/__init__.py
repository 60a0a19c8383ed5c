"""See the README for what this layer holds."""
