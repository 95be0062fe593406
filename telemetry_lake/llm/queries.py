"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from telemetry_lake.llm.cover_tree import op7_cover_tree
from telemetry_lake.llm.divergence import OP13_SQL, op13_divergence
from telemetry_lake.llm.fingerprints import op1_fingerprints
from telemetry_lake.llm.line_dedup import OP11_SQL, op11_line_dedup
from telemetry_lake.llm.packing import op9_packing
from telemetry_lake.llm.quality import op5_quality
from telemetry_lake.llm.sentencepiece_lattice import op6_sentencepiece
from telemetry_lake.llm.simhash import op2_simhash
from telemetry_lake.llm.substring import op4_substring
from telemetry_lake.llm.token_files import op3_token_files
from telemetry_lake.llm.url_filter import op10_url_filter
from telemetry_lake.llm.warc import OP8_SQL, op8_warc
from telemetry_lake.llm.whitening import op12_whitening

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_token_files": op3_token_files,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_cover_tree": op7_cover_tree,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}
SQL: dict[str, str] = {"op8_warc": OP8_SQL, "op11_line_dedup": OP11_SQL, "op13_divergence": OP13_SQL}
