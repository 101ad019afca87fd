"""Operators that turn raw collections into training text."""
