"""The operators applied to the driver's tables, with the SQL that must give the same rows."""

from workload import (cleaning, folding, history, incremental, joining, learning, panels, quality, scoring,  # noqa: F401
                      sources, splitting)
from workload.registry import ORACLES, QUERIES  # noqa: F401
