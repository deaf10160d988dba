"""Column-expression helpers (JVM-side; no Python UDFs)."""
