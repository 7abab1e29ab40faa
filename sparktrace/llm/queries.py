"""The registered queries of the corpus operators and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from sparktrace.llm.bpe import op10_bpe
from sparktrace.llm.html import op6_html
from sparktrace.llm.langid import op5_langid
from sparktrace.llm.lexical import OP12_SQL, op12_treap
from sparktrace.llm.licenses import op13_licenses
from sparktrace.llm.lines import OP4_SQL, op4_lines
from sparktrace.llm.middle import OP11_SQL, op11_middle
from sparktrace.llm.outliers import op9_outliers
from sparktrace.llm.packing import op3_packing
from sparktrace.llm.quality import op1_quality
from sparktrace.llm.repeats import op8_repeats
from sparktrace.llm.simhash import op2_simhash
from sparktrace.llm.topk import OP7_SQL, op7_topk

QUERIES = {"op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_packing": op3_packing, "op4_lines": op4_lines, "op5_langid": op5_langid, "op6_html": op6_html, "op7_topk": op7_topk, "op8_repeats": op8_repeats, "op9_outliers": op9_outliers, "op10_bpe": op10_bpe, "op11_middle": op11_middle, "op12_treap": op12_treap, "op13_licenses": op13_licenses}
ORACLES: dict[str, str] = {"op4_lines": OP4_SQL, "op7_topk": OP7_SQL, "op11_middle": OP11_SQL, "op12_treap": OP12_SQL}
