"""Structured Streaming jobs; each ends in the state its batch operator gives."""
