"""Readers, idempotent writers and page scans."""
