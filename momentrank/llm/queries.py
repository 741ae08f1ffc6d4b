"""Registered queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from .bloomlm import op6_bloomlm
from .hnsw import op9_hnsw
from .merkle import OP13_SQL, op13_merkle
from .mixing import OP3_SQL, op3_mixing
from .pieces import op5_pieces
from .quality import op10_quality
from .quotes import op1_quotes
from .repair import OP12_SQL, op12_repair
from .simhash import op2_simhash
from .sketch import op7_sketch
from .toxicity import op8_toxicity
from .urlfilter import OP4_SQL, op4_urlfilter
from .wrapper import op11_wrapper

QUERIES = {
    "op1_quotes": op1_quotes,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_urlfilter": op4_urlfilter,
    "op5_pieces": op5_pieces,
    "op6_bloomlm": op6_bloomlm,
    "op7_sketch": op7_sketch,
    "op8_toxicity": op8_toxicity,
    "op9_hnsw": op9_hnsw,
    "op10_quality": op10_quality,
    "op11_wrapper": op11_wrapper,
    "op12_repair": op12_repair,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL, "op4_urlfilter": OP4_SQL, "op12_repair": OP12_SQL, "op13_merkle": OP13_SQL}
