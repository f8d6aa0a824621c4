"""Registers of organisations and places, cleaned, searched, geocoded and mapped with Spark."""
