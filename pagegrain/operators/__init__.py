"""Operators on page boxes, texts and job events."""
