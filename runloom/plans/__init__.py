"""Named queries over the fixture store."""

from . import agents, ingests, records, stores, streams, telemetry, tools  # noqa: F401  each module adds its own
from .queries import ORACLES, QUERIES  # noqa: F401
