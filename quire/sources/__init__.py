"""Scans and sinks: binary files to tables and back."""
