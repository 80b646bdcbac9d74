"""Structured Streaming: decode and lifecycle over arriving logs."""
