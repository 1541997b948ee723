"""Inputs, and the queries with their SQL: importing this package fills the catalogue with all of them."""

from . import catalogue, sessions, storage

__all__ = ["catalogue", "sessions", "storage"]
