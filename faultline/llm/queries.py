"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import arrow_files, impact_index, line_dedup, manifest, near_dedup, packing, preference, prefix_trie, quality, secret_scan, substring_dedup, token_counts, transducer
from .common import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_near_dedup", near_dedup.SQL)
def _near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


query("op2_preference", preference.SQL)(preference.preferences)


@query("op3_packing")
def _packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op4_token_files")
def _token_files(spark, sf_dir):
    return arrow_files.round_trip(read(spark, sf_dir, "documents"))


@query("op5_bpe")
def _bpe(spark, sf_dir):
    return transducer.digests(read(spark, sf_dir, "documents"))


@query("op6_quality")
def _quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents")).drop("level")


@query("op7_top_k", impact_index.SQL)
def _top_k(spark, sf_dir):
    return impact_index.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op8_secrets")
def _secrets(spark, sf_dir):
    return secret_scan.scan(read(spark, sf_dir, "documents"))


@query("op9_line_dedup", line_dedup.SQL)
def _line_dedup(spark, sf_dir):
    return line_dedup.cleaned(read(spark, sf_dir, "documents"))


@query("op10_token_counts")
def _token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@query("op11_substrings")
def _substrings(spark, sf_dir):
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.SQL)
def _prefix_trie(spark, sf_dir):
    return prefix_trie.shared_prefixes(read(spark, sf_dir, "conversations"))


@query("op13_manifest", manifest.SQL)
def _manifest(spark, sf_dir):
    return manifest.manifest(read(spark, sf_dir, "documents"))
