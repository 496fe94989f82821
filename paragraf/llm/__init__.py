"""Operators that prepare texts for training; nothing outside this folder imports it."""
