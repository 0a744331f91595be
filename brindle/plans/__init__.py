"""Queries by area; importing this package registers all of them in ``catalogue``."""

from . import catalogue, analytic, extensions, formats, scalar, scale, streams  # noqa: F401, I001
