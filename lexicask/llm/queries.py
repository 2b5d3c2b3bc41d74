"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from lexicask.llm.chat import OP3_SQL, op3_chat_round_trip
from lexicask.llm.embeddings import op5_itq_embeddings
from lexicask.llm.langid import language_of_pages, op4_language_evidence
from lexicask.llm.maxent import op8_maxent_scores
from lexicask.llm.mixing import OP1_SQL, op1_pfair_mixing
from lexicask.llm.neardup import op6_weighted_minhash
from lexicask.llm.packing import op10_curve_packing
from lexicask.llm.quality import OP7_SQL, op7_quality_rules
from lexicask.llm.tokenfiles import op2_token_files
from lexicask.llm.warc import op9_warc_derivatives

QUERIES = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_token_files": op2_token_files,
    "op3_chat_round_trip": op3_chat_round_trip,
    "op4_language_evidence": op4_language_evidence,
    "op5_itq_embeddings": op5_itq_embeddings,
    "op6_weighted_minhash": op6_weighted_minhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_maxent_scores": op8_maxent_scores,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_curve_packing": op10_curve_packing,
    "language_of_pages": language_of_pages,
}
ORACLE_SQL = {"op1_pfair_mixing": OP1_SQL, "op3_chat_round_trip": OP3_SQL, "op7_quality_rules": OP7_SQL}
