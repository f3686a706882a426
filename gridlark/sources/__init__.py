"""Readers and writers of annotation, prediction, trace and run files."""
