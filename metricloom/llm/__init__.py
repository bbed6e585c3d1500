"""Operators for training corpora; the rest of the library never imports this subpackage."""
