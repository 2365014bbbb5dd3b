"""Readers of the driver tables and the layout records derived from them."""
