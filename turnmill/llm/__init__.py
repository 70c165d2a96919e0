"""Preparation of text and event sequences for training. Nothing outside of this subpackage imports it."""
