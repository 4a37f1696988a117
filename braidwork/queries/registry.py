"""All registered queries; importing a module registers its own."""

from __future__ import annotations

from braidwork.queries import boundaries, checks, columns, compare, events, genotypes, graphs, intervals, kernels, oriented, panels, paths, projection, records, sequences, splicing, units, walks  # noqa: F401
from braidwork.queries.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "path_size_metrics"
