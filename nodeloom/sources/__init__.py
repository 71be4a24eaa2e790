"""Readers and writers: structure files, tables, generated point clouds."""
