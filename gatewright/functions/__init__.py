"""Column-to-Column functions (JVM-side, inside whole-stage codegen wherever Spark allows it)."""
