"""Weftline: a pipe language for nested documents, compiled to Spark plans."""
