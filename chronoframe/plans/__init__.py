"""Composed layers, reports and benchmark shapes."""
