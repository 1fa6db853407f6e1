"""Analog tables, registered queries and their SQL."""
