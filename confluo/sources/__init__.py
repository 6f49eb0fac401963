"""Readers that turn files into frames of partial records."""
