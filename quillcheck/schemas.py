"""Explicit schemas of the record types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "as": T.ArrayType(T.StringType()), "m": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


PARSED_VALUE = _struct("df1:i df2:i n:i op:s f:d p:d p_adj:d beta:d dz:d alpha:d eta_sq:d v:d m:d sd:d ci_low:d ci_high:d pct:d rho:d irr:d r:d")
MANUSCRIPT = _struct("id:s file_path:s section:s version:s sha256:s word_count:i last_modified:s")
LINE = _struct("manuscript_id:s ms_ord:i section:s line_no:i text:s")
CLAIM = T.StructType([*_struct("id:s manuscript_id:s section:s line_no:i raw_text:s claim_type:s").fields, T.StructField("parsed_value", PARSED_VALUE), *_struct("context_snippet:s start_pos:i end_pos:i raw_values:m").fields])
TRUTH = _struct("dv:s f:d df1:i df2:i p_r:d p_scipy:d beta:d se:d ci_low:d ci_high:d v:d p_wil:d r:d dz:d parity:s m_hq:d sd_hq:d m_lq:d sd_lq:d alpha:d validation_errors:as")
RESULT = _struct("id:s target_type:s target_id:s verifier:s status:s evidence:s expected_value:d computed_value:d delta:d matched_dv:s")
REFERENCE = _struct("id:s raw_text:s authors_raw:s first_author_last:s year:i title:s year_suffix:s journal:s doi:s status:s crossref_match:s pdf_attached:b notes:s")
CITATION = _struct("id:s manuscript_id:s section:s line_no:i raw_text:s citation_type:s first_author_last:s year:i year_suffix:s ref_id:s context_paraphrase:s year_alt:i citation_purpose:s")
SOURCE_FILE = _struct("id:s ref_id:s pdf_path:s source_kind:s extracted_quote:s span_page:s extracted_at:s")
PARAPHRASE = _struct("id:s citation_id:s ref_id:s pdf_path:s paraphrase_text:s extracted_quote:s score:d verifier:s status:s citation_purpose:s threshold_applied:d")
