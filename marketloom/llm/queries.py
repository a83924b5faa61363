"""The registered queries of the operators and their SQL."""

from marketloom.llm.alignment import op13_alignment
from marketloom.llm.ctw import op3_ctw
from marketloom.llm.decontaminate import OP7_SQL, op7_decontamination
from marketloom.llm.language import op10_language
from marketloom.llm.lattice import op6_lattice
from marketloom.llm.packing import op5_packing
from marketloom.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from marketloom.llm.quality import op4_quality
from marketloom.llm.secret_scan import op8_secrets
from marketloom.llm.simhash import op2_simhash
from marketloom.llm.token_store import op11_orc
from marketloom.llm.toxicity import op1_toxicity
from marketloom.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_ctw, op4_quality, op5_packing, op6_lattice, op7_decontamination,
                                   op8_secrets, op9_warc, op10_language, op11_orc, op12_prefix_trie, op13_alignment)}
ORACLES = {"op7_decontamination": OP7_SQL, "op9_warc": OP9_SQL, "op12_prefix_trie": OP12_SQL}
