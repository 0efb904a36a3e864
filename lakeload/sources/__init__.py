"""File readers."""
