"""DataFrame operators: joins, trees, stripes, sinks."""
