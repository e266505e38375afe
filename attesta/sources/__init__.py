"""Readers of landed files and payloads. No reader calls a network service."""
