"""File-source streams feeding the same operators."""

from .weather import daily_stream  # noqa: F401
