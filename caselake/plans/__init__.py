"""Registered queries over the driver's tables; importing this fills the registry."""

from . import catalogs, linking, logs, scanning, sequences, triaging  # noqa: F401, I001
from . import live  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
