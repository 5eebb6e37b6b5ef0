"""Column expressions: everything here stays in the JVM."""
