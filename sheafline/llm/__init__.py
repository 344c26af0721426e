"""Operators for preparing training text, one module each; nothing else in sheafline imports this subpackage."""
