"""All registered queries of the travel-time engine and their SQL."""

from wayfold.plans import archives, choices, columns, contracts, exports, extra, journeys, montecarlo, more, overlays, places, planned, search, service, stations, steps, stream, timetable  # noqa: F401  registered on import
from wayfold.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "r10_arrive_by"
