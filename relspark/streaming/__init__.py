"""Live queries and external changes."""
