"""Connected components, as the training-data operators use them."""

from ..operators.undirected import connected_components

__all__ = ["connected_components"]
