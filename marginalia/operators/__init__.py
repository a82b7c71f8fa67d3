"""Relational operators over nodes, edges, imports and sources."""
