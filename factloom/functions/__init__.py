"""Column expressions (JVM side) and the few Arrow UDFs Spark has no built-in for."""
