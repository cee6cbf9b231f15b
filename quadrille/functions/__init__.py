"""Column expressions on boxes and geometries."""
