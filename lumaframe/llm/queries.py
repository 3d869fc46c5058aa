"""The operators as queries, and the SQL of those that SQL can express."""

from .centroids import OP12_SQL, op12_clusters
from .chat import OP4_SQL, op4_chat
from .decontaminate import OP1_SQL, op1_decontaminate
from .langid import op3_langid
from .lm import op7_lm
from .packing import op10_pack
from .phrases import OP13_SQL, op13_phrases
from .pii import OP6_SQL, op6_pii
from .simhash import op5_simhash
from .substrings import op9_substrings
from .tokencount import op11_tokens
from .topk import OP8_SQL, op8_topk
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_langid": op3_langid,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_lm": op7_lm,
    "op8_topk": op8_topk,
    "op9_substrings": op9_substrings,
    "op10_pack": op10_pack,
    "op11_tokens": op11_tokens,
    "op12_clusters": op12_clusters,
    "op13_phrases": op13_phrases,
}
SQL = {
    "op1_decontaminate": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op4_chat": OP4_SQL,
    "op6_pii": OP6_SQL,
    "op8_topk": OP8_SQL,
    "op12_clusters": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
