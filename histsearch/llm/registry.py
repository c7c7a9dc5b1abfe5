"""The queries of this subpackage, by name, and their oracle SQL."""

from .fixity import OP6_SQL, op6_merkle_fixity
from .hosts import OP1_SQL, op1_host_rules
from .lines import op9_line_dedup
from .mixing import op10_hash_threshold_mix
from .packing import op8_pattern_packing
from .quality import op7_bradley_terry_quality
from .sharding import op2_bounded_ring
from .simhash import op5_covering_simhash
from .spotsigs import op3_spotsigs
from .urls import op4_url_trees

QUERIES = {
    "op1_host_rules": op1_host_rules,
    "op2_bounded_ring": op2_bounded_ring,
    "op3_spotsigs": op3_spotsigs,
    "op4_url_trees": op4_url_trees,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_merkle_fixity": op6_merkle_fixity,
    "op7_bradley_terry_quality": op7_bradley_terry_quality,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_hash_threshold_mix": op10_hash_threshold_mix,
}

ORACLE_SQL = {
    "op1_host_rules": OP1_SQL,
    "op6_merkle_fixity": OP6_SQL,
}
