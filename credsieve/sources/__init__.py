"""Sources: text tables, file trees, diffs, rule tables, baselines."""
