"""Structured Streaming: rollups kept up to date as readings arrive."""
