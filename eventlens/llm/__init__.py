"""Operators for preparing training data, one module each; `registry` lists their queries."""
