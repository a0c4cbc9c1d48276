"""DataFrame operators: detection, suppression, diffs, summaries."""
