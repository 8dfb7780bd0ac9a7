"""Readers and writers of the file formats that networks, logs and results come in."""
