"""Operators for preparing large training corpora (one module each).

Nothing outside this subpackage imports it; ``queries`` registers one query
per operator."""
