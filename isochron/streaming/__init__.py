"""Streaming forms of the trailing-window operators."""
