"""Column functions: each takes and returns Spark columns, so all of it runs inside the JVM."""
