"""Column functions: everything here maps columns to columns and stays inside the JVM."""
