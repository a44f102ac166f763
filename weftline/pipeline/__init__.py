"""Declarative pipelines: sources, a shared document, outputs, destinations."""
