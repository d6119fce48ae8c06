"""Operators for preparing training text. Nothing else in plumbline imports this subpackage."""
