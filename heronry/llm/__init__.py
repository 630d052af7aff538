"""Operators for preparing training text and its telemetry; nothing outside imports this subpackage."""
