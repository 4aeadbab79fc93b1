"""Arrow batches of bounded size for Python stages."""

from __future__ import annotations

from webloom.runtime import small_batches

__all__ = ["small_batches"]
