"""Readers, and the canonical tables that operators work on."""
