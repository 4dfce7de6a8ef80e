"""Registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from .ann import nearest
from .audio import audio_query
from .bpe import bpe_query
from .chat import chat_query
from .common import table
from .licenses import license_scan, license_sql
from .mixing import mix_sources, mixing_sql
from .near import near_duplicates
from .quality import score_quality
from .substrings import substring_query
from .toxicity import score_toxicity

_MIX = ["doc_id", "size", "source_size", "target", "taken"]
QUERIES = {
    "op1_toxicity": lambda spark, sf_dir: score_toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op2_audio": lambda spark, sf_dir: audio_query(table(spark, sf_dir)),
    "op3_chat": chat_query,
    "op4_neighbours": lambda spark, sf_dir: nearest(table(spark, sf_dir, "embeddings")),
    "op5_near": lambda spark, sf_dir: near_duplicates(table(spark, sf_dir), words=2),
    "op6_quality": lambda spark, sf_dir: score_quality(table(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted"),
    "op7_substrings": lambda spark, sf_dir: substring_query(table(spark, sf_dir)),
    "op8_bpe": lambda spark, sf_dir: bpe_query(table(spark, sf_dir)),
    "op9_mixing": lambda spark, sf_dir: mix_sources(table(spark, sf_dir)).select(_MIX),
    "op10_licenses": lambda spark, sf_dir: license_scan(table(spark, sf_dir)),
}
ORACLES = {"op9_mixing": mixing_sql(), "op10_licenses": license_sql()}
