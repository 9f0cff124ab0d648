"""Operators for preparing training text: ten DataFrame-in, DataFrame-out functions and their queries."""
