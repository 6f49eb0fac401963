"""End-to-end plans: merge, projection, validation, command line."""
