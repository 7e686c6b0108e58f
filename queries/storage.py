"""Folders for what a query writes."""

from chronoframe.session import new_folder, stored

__all__ = ["new_folder", "stored"]
