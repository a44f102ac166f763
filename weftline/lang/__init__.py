"""The language: tokens, syntax tree, parser, diagnostics, and evaluation over plain values."""
