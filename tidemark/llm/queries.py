"""The queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .html_extraction import op7_html_extraction
from .language_id import op1_language_id
from .licenses import op3_licenses
from .media import op10_media
from .packing import op5_packing
from .quality import op9_quality
from .secrets import op4_secrets
from .simhash import op6_simhash
from .token_counts import op8_token_counts

QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_licenses, op4_secrets, op5_packing, op6_simhash, op7_html_extraction, op8_token_counts, op9_quality, op10_media)}

#: None of the ten is expressible in SQL at whole-table size; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
