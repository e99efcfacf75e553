"""Readers of the input tables and the roles that queries give them."""
