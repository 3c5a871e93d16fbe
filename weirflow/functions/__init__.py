"""Column expressions; all are built-in functions, so that plans stay inside the JVM."""
