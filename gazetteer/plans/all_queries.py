"""All query modules, imported for what they register."""

from gazetteer.plans import dataset_queries, evidence_queries, flow_queries, image_queries, quality_queries, question_queries, search_queries, web_queries
from gazetteer.plans.registry import ORACLES, QUERIES

MODULES = [
    dataset_queries, search_queries, web_queries, image_queries, evidence_queries, flow_queries,
    question_queries, quality_queries,
]

__all__ = ["MODULES", "ORACLES", "QUERIES"]
