"""kinfold: a Spark-native engine for entity-relation data.

Declare entities, relations and views (`model`), bind them to DataFrames (`sources.Catalog`), ask graph-shaped questions
(`plans.find`), and keep derived values right, in batch, from change logs or on streams (`operators`, `streaming`).
"""

from .model import Dictionary, Entity, FilteredEntity, MergedEntity, ModelError, Property, Relation
from .plans.boolexp import BoolExp
from .plans.match import Match
from .plans.query import find, find_one, find_path, find_relation, traverse
from .sources.catalog import Catalog

__all__ = ["BoolExp", "Catalog", "Dictionary", "Entity", "FilteredEntity", "Match", "MergedEntity", "ModelError", "Property", "Relation", "find", "find_one", "find_path", "find_relation", "traverse"]
