"""Streams of arriving structures and of training losses."""
