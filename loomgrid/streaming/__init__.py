"""Newer extracts as they arrive. The batch library replaces whole years; this feeds the same replacement from a stream of files."""
