"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.bpe import op1_bpe
from kinweave.llm.chat import OP9_SQL, op9_chat
from kinweave.llm.embeddings import OP6_SQL, op6_embedding_near_dedup
from kinweave.llm.jaccard import OP5_SQL, op5_jaccard
from kinweave.llm.licences import OP3_SQL, op3_licences
from kinweave.llm.lines import OP12_SQL, op12_line_dedup
from kinweave.llm.pii import op7_pii
from kinweave.llm.runs import op11_periodic_runs
from kinweave.llm.sharding import op4_sharding
from kinweave.llm.substrings import op10_substrings
from kinweave.llm.toxicity import op2_toxicity
from kinweave.llm.whitening import op13_whitening
from kinweave.llm.wumanber import OP8_SQL, op8_decontamination

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_licences": op3_licences,
    "op4_sharding": op4_sharding,
    "op5_jaccard": op5_jaccard,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_chat": op9_chat,
    "op10_substrings": op10_substrings,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op3_licences": OP3_SQL, "op5_jaccard": OP5_SQL, "op6_embedding_near_dedup": OP6_SQL, "op8_decontamination": OP8_SQL, "op9_chat": OP9_SQL, "op12_line_dedup": OP12_SQL}
