"""Readers, text-column choice and writers."""
