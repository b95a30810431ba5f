"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .counting import op4_edit_aware_token_counts
from .fingerprints import op2_homomorphic_fingerprints
from .lm import op9_causal_attention_scores
from .mixing import op1_weighted_fair_queueing
from .neardup import ORACLE_SQL as NEAR_SQL
from .neardup import op3_probminhash_near_duplicates
from .packing import op10_best_fit_swaps
from .pii import op7_boosted_candidates
from .quality import ORACLE_SQL as QUALITY_SQL
from .quality import op8_host_quality_rules
from .secrets import ORACLE_SQL as SECRETS_SQL
from .secrets import op6_blob_ledger_secrets
from .toxicity import op5_subword_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_weighted_fair_queueing,
        op2_homomorphic_fingerprints,
        op3_probminhash_near_duplicates,
        op4_edit_aware_token_counts,
        op5_subword_toxicity,
        op6_blob_ledger_secrets,
        op7_boosted_candidates,
        op8_host_quality_rules,
        op9_causal_attention_scores,
        op10_best_fit_swaps,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_probminhash_near_duplicates": NEAR_SQL,
    "op6_blob_ledger_secrets": SECRETS_SQL,
    "op8_host_quality_rules": QUALITY_SQL,
}
