"""tamga: evaluation analytics as plain DataFrame -> DataFrame functions."""

__version__ = "0.2.0"
