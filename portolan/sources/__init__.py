"""Readers, enrichment and the flow view over star tables."""
