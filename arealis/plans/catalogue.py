"""All registered queries."""

from . import (food_queries, index_queries, key_queries, model_queries, source_queries,  # noqa: F401
               spatial_queries, survey_queries)
from .base import ORACLES, QUERIES  # noqa: F401
