"""Queries of the operators in this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, merkle, prefix_trie, sharding
from .hash_forest import op10_hash_forest
from .jaccard_join import op5_jaccard_join
from .language_id import op2_language_id
from .lm_scoring import op9_lm_scoring
from .merkle import op11_merkle_manifest
from .mixing import op6_mixing
from .pii import op8_pii
from .prefix_trie import op12_prefix_trie
from .quality_classifier import op3_quality_classifier
from .quality_rules import op7_quality_rules
from .secret_scan import op1_secret_scan
from .sentencepiece_codec import op4_sentencepiece
from .sharding import op13_sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_quality_classifier, op4_sentencepiece, op5_jaccard_join, op6_mixing, op7_quality_rules, op8_pii, op9_lm_scoring, op10_hash_forest, op11_merkle_manifest, op12_prefix_trie, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": jaccard_join.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_sharding": sharding.ORACLE_SQL}
