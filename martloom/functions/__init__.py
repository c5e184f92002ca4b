"""Column expressions: cleaning, parsing, text rules. Everything here stays inside the JVM."""
