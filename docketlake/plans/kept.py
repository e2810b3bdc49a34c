"""Tables that are used several times and must not be made again, such as what models have returned."""

from ..storage import kept

__all__ = ["kept"]
