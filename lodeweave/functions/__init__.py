"""See the package docstring of lodeweave."""
