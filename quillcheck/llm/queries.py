"""Named queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillcheck.llm.bpe import p7_ids
from quillcheck.llm.catalog import p1_found, p1_unmatched
from quillcheck.llm.leakage import p8_found, p8_removal_spans
from quillcheck.llm.lookalike import p3_found, p3_plain
from quillcheck.llm.name_variants import p6_found
from quillcheck.llm.scan_repair import p2_found, p2_repaired
from quillcheck.llm.sentences import p9_found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_unmatched": p1_unmatched,
        "p2_found": p2_found,
        "p2_repaired": p2_repaired,
        "p3_found": p3_found,
        "p3_plain": p3_plain,
        "p6_found": p6_found,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_removal_spans": p8_removal_spans,
        "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    return {}
