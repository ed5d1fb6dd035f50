"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from quern.llm.decontamination import op9_decontamination
from quern.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from quern.llm.line_dedup import OP7_SQL, op7_line_dedup
from quern.llm.mixing import OP10_SQL, op10_source_mixing
from quern.llm.near_dedup import OP4_SQL, op4_near_dedup
from quern.llm.pseudonyms import op3_pii_pseudonyms
from quern.llm.quality import op5_quality
from quern.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from quern.llm.token_output import op8_token_output
from quern.llm.warc_fixity import OP6_SQL, op6_warc_fixity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_output": op8_token_output,
    "op9_decontamination": op9_decontamination,
    "op10_source_mixing": op10_source_mixing,
}
#: The others are not expressible in SQL; tests/llm holds them against brute force.
ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op4_near_dedup": OP4_SQL,
    "op6_warc_fixity": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_source_mixing": OP10_SQL,
}
