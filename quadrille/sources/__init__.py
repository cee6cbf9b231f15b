"""Readers of layers and geometries."""
