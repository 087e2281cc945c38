"""Column expressions (JVM built-ins only, no Python UDFs)."""
