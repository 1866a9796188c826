"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.licenses import op8_licenses
from spanloom.llm.lm import op9_lm
from spanloom.llm.mixing import op2_mix
from spanloom.llm.nearcopies import op6_near
from spanloom.llm.oracles import ORACLE_SQL as ORACLE_SQL
from spanloom.llm.packing import op3_packing
from spanloom.llm.quality import op5_quality
from spanloom.llm.secrets import op10_secrets
from spanloom.llm.substrings import op1_substrings
from spanloom.llm.topk import op4_topk
from spanloom.llm.urls import op7_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_mix": op2_mix,
    "op3_packing": op3_packing,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_near": op6_near,
    "op7_urls": op7_urls,
    "op8_licenses": op8_licenses,
    "op9_lm": op9_lm,
    "op10_secrets": op10_secrets,
}
