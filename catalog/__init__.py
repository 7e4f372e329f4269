"""Registered queries and the SQL a second engine answers them with."""
