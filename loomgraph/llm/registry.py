"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from loomgraph.llm.centroids import OP12_SQL, op12_centroids
from loomgraph.llm.decontaminate import OP13_SQL, op13_decontamination
from loomgraph.llm.fingerprint import op6_fingerprints
from loomgraph.llm.html import op5_html
from loomgraph.llm.jaccard import OP10_SQL, op10_jaccard
from loomgraph.llm.language import op3_language
from loomgraph.llm.mixing import op9_mixing
from loomgraph.llm.packing import op2_packing
from loomgraph.llm.quality import OP8_SQL, op8_quality
from loomgraph.llm.secrets import op7_secrets
from loomgraph.llm.toxicity import op1_toxicity
from loomgraph.llm.trie import OP11_SQL, op11_trie
from loomgraph.llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_language, op4_warc, op5_html, op6_fingerprints, op7_secrets, op8_quality, op9_mixing, op10_jaccard, op11_trie, op12_centroids, op13_decontamination)}
ORACLE_SQL = {"op8_quality": OP8_SQL, "op10_jaccard": OP10_SQL, "op11_trie": OP11_SQL, "op12_centroids": OP12_SQL, "op13_decontamination": OP13_SQL}
