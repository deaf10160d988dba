"""Composed plans: derived run tables, the whole cycle, registered queries."""
