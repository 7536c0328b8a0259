"""Stateful operators on streams of numbers."""
