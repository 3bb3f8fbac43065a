"""Operators for preparing a text corpus for training; nothing outside this folder imports them."""
