"""Typing and lowering of scripts to DataFrames and columns."""
