"""Readers that turn caption files, listings and agendas into tables."""
