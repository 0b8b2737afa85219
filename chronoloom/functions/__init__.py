"""Column functions (Column in, Column out), all JVM-side."""
