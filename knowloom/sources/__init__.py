"""Readers, writers and the mapping of warehouse tables onto the entity model."""
