"""Capture, weather and tag analytics as plain DataFrame functions."""

from trailtally.session import configure, get_session

__all__ = ["configure", "get_session"]
