"""Queries of this package and their SQL, for the entry point."""

from __future__ import annotations

from .alignment import op11_space_anchors
from .bpe import op12_rank_queue
from .decontam import op2_spaced_seeds
from .jaccard import op3_partenum_join
from .mixing import OP1_SQL, op1_pareto_mix
from .oracles import OP3_SQL, OP8_SQL
from .pii import op6_feistel_pseudonyms
from .quality import op8_quality_rules
from .rollups import op10_token_rollups
from .secrets import op4_credential_links
from .sharding import op5_hash_ring
from .toxicity import op9_noisy_channel
from .warc import OP7_SQL, op7_capture_index
from .whitening import op13_characteristic_polynomial

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_partenum_join": op3_partenum_join,
    "op4_credential_links": op4_credential_links,
    "op5_hash_ring": op5_hash_ring,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_capture_index": op7_capture_index,
    "op8_quality_rules": op8_quality_rules,
    "op9_noisy_channel": op9_noisy_channel,
    "op10_token_rollups": op10_token_rollups,
    "op11_space_anchors": op11_space_anchors,
    "op12_rank_queue": op12_rank_queue,
    "op13_characteristic_polynomial": op13_characteristic_polynomial,
}
ORACLES: dict[str, str] = {
    "op1_pareto_mix": OP1_SQL,
    "op3_partenum_join": OP3_SQL,
    "op7_capture_index": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
}
