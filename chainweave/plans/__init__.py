"""Reusable plan fragments: lineage cutting, graph components, checked broadcasts."""
