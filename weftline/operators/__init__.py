"""Pipe operators over frames, groups of their items, tables looked up from items, and arrays within items."""
