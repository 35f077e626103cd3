"""Readers, parsers of native formats, and sinks."""
