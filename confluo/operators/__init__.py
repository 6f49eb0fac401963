"""Relational building blocks: blocking, scoring, components, fusion."""
