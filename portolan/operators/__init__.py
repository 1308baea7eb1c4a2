"""Analyses over flow tables, one module per subject."""
