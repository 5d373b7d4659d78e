"""Connected components, shared with the operators on changes."""

from codeweave.operators.components import components

__all__ = ["components"]
