"""Readers and writers for layers, tables, weather files and reports."""
