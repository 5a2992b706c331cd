"""Queries of the training-data operators and the SQL they are held against."""

from engine.llm.contamination import p9_alignments, p9_found
from engine.llm.described import p3_found, p3_pairs
from engine.llm.encoding import p8_ids
from engine.llm.furniture import p5_bodies, p5_found
from engine.llm.fusion import P6_RANKING_SQL, P6_SQL, p6_found, p6_ranking
from engine.llm.markup import p1_clean, p1_found
from engine.llm.neighbours import P4_SQL, p4_found
from engine.llm.personal import p10_found, p10_masked
from engine.llm.provenance import p7_found

QUERIES = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_bodies": p5_bodies,
    "p6_found": p6_found,
    "p6_ranking": p6_ranking,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_alignments": p9_alignments,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
}
SQL = {"p4_found": P4_SQL, "p6_found": P6_SQL, "p6_ranking": P6_RANKING_SQL}
