"""Column expressions: Column in, Column out, all of them in the JVM but for two similarity functions."""
