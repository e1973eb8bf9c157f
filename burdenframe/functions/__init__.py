"""Column-level helpers; every function maps columns to columns and stays in the JVM."""
