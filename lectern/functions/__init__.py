"""See README.md for the map of this package."""
