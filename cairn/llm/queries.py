"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .chat_format import OP4_SQL, op4_chat_formatting
from .decontamination import op1_decontamination
from .jaccard_join import op5_jaccard_join
from .language_id import op10_language_id
from .mixing import OP6_SQL, op6_mixing
from .pii import op9_pii
from .quality_rules import OP3_SQL, op3_quality_rules
from .sharding import op8_sharding
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op2_token_counts


def queries():
    found = [op1_decontamination, op2_token_counts, op3_quality_rules, op4_chat_formatting, op5_jaccard_join, op6_mixing, op7_suffix_dedup, op8_sharding, op9_pii, op10_language_id]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_quality_rules": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op6_mixing": OP6_SQL}
