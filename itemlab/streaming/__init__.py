"""Stateless scoring of arriving rows."""
