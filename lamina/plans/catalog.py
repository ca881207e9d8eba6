"""Name -> query and name -> oracle SQL for the reference's own operators."""

from __future__ import annotations

from lamina.plans import reading, telemetry, training

#: Each has SQL; PIXEL_QUERIES have none.
QUERIES = {**reading.QUERIES, **telemetry.QUERIES, **training.QUERIES}
PIXEL_QUERIES = reading.PIXEL_QUERIES
ORACLES = {**reading.ORACLES, **telemetry.ORACLES, **training.ORACLES}
