"""Registered queries. Importing a module of this package registers its queries."""

from lodestone.plans import assembly_queries, content_queries, flow_queries, jobs_queries, retrieval_queries, state_queries, stream_queries, structure_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES  # noqa: F401
