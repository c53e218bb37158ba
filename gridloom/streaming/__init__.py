"""Keyed stateful profiles and windowed metrics over streams."""
