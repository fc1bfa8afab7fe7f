"""Operators for preparing training corpora: one module per operator, plus their registered queries."""
