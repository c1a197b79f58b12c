"""Readers of files and deliveries."""
