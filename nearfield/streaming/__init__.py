"""Streams of queries against a standing index."""

from nearfield.streaming.queries import search_stream  # noqa: F401
