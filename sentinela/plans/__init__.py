"""Composite jobs: the weekly refresh and the registered queries."""
