"""Operators over box, image and run tables."""
