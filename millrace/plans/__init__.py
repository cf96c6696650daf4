"""Scopes, schemas and views shared by operators."""
