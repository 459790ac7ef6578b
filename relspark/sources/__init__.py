"""Stores, export and import, upgrades and inspection."""
