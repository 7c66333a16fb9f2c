"""The corpus queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from colguard.llm.decontaminate import op1_decontamination
from colguard.llm.language_id import op2_language_id
from colguard.llm.line_dedup import ORACLE_OP8, op8_line_dedup
from colguard.llm.mixing import op7_mixing
from colguard.llm.near_dedup import op5_near_dedup
from colguard.llm.quality import op4_quality
from colguard.llm.secrets import op6_secrets
from colguard.llm.sharding import op3_sharding
from colguard.llm.token_store import op10_token_store
from colguard.llm.topk import ORACLE_OP9, op9_top_k

QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_language_id, op3_sharding, op4_quality, op5_near_dedup, op6_secrets, op7_mixing, op8_line_dedup, op9_top_k, op10_token_store)
}

#: The others can't be put in SQL (models, components, hashes of their own); tests hold them against brute force.
ORACLES = {"op8_line_dedup": ORACLE_OP8, "op9_top_k": ORACLE_OP9}
