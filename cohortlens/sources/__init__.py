"""Readers, row parsers and sinks for landed survey files."""
