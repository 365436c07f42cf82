"""Reading and writing the tables and files that the library works on."""

from .tables import read

__all__ = ["read"]
