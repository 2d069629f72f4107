"""Queries over the general tables. Importing ``queries`` registers all of them."""
