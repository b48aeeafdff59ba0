"""The queries of the operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import op6_role_repair
from .common import load
from .decontaminate import OP2_SQL, op2_benchmark_decontamination
from .kneser_ney import op5_kneser_ney
from .packing import op8_best_fit_packing
from .quality import op7_ordinal_quality
from .sharding import op3_histogram_shards
from .simhash import near_duplicates
from .url_filters import op9_link_graph_filter
from .warc import OP4_SQL, op4_dictionary_warc
from .webp import op10_lossless_webp


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_benchmark_decontamination, op3_histogram_shards, op4_dictionary_warc, op5_kneser_ney, op6_role_repair, op7_ordinal_quality, op8_best_fit_packing, op9_link_graph_filter, op10_lossless_webp)}
SQL = {"op2_benchmark_decontamination": OP2_SQL, "op4_dictionary_warc": OP4_SQL}
