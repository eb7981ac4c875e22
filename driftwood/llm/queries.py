"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontam, jaccard_join, kmeans, lines
from .bpe import op6_byte_bpe
from .decontam import op4_decontaminate
from .jaccard_join import op3_jaccard_join
from .kmeans import op12_centroid_clusters
from .langid import op5_language_id
from .lattice import op10_lattice_dedup
from .lines import op1_line_dedup
from .passages import op2_repeated_passages
from .pii import op9_pii
from .secrets import op11_secret_scan
from .tokcount import op7_token_counts
from .urls import op8_url_filters
from .whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_repeated_passages, op3_jaccard_join, op4_decontaminate, op5_language_id, op6_byte_bpe, op7_token_counts, op8_url_filters, op9_pii, op10_lattice_dedup, op11_secret_scan, op12_centroid_clusters, op13_embedding_whitening)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": lines.oracle_sql(), "op3_jaccard_join": jaccard_join.oracle_sql(), "op4_decontaminate": decontam.ORACLE_SQL, "op12_centroid_clusters": kmeans.oracle_sql()}
