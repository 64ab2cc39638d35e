"""Plans: the property graph, the build that writes it, the reads and the report."""
