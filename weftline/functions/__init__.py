"""Functions of the language: over plain values, and as Spark columns."""
