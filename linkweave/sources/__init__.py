"""Readers, writers, the entity store and the model registry."""
