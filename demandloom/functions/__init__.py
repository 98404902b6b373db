"""Column-level building blocks; everything here is a JVM-side expression."""
