"""Readers that turn tables and files into spans, segments and pages."""
