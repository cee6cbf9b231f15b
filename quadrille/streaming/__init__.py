"""Streams of boxes."""
