"""Readers of documents and of the engine's own inputs."""
