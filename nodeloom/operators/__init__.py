"""Operators on tables of atoms, points, nodes, edges and angles."""
