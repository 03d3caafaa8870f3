"""All registered queries; importing the package fills the registry."""

from tidelake.catalog import (  # noqa: F401
    audits,
    exposure,
    features,
    ingest,
    models,
    quality,
    runlogs,
    streams,
    training,
)
from tidelake.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
