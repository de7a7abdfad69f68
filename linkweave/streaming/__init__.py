"""Streaming resolution."""
