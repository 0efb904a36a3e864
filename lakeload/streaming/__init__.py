"""Recurring loads."""
