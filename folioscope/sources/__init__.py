"""Readers: paper metadata, pending content, caches, binary documents, payloads."""
