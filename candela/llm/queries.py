"""The queries of this subpackage, and SQL for those that SQL can express."""

from candela.llm.alignment import op12_alignment
from candela.llm.decontamination import OP5_SQL, op5_decontamination
from candela.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from candela.llm.line_dedup import OP1_SQL, op1_line_dedup
from candela.llm.mixing import OP9_SQL, op9_mixing
from candela.llm.ngram_join import OP3_SQL, op3_ngram_join
from candela.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from candela.llm.secret_scan import op6_secret_scan
from candela.llm.simhash import op13_simhash
from candela.llm.suffix_dedup import op7_suffix_dedup
from candela.llm.token_counts import op4_token_counts
from candela.llm.toxicity import op10_toxicity
from candela.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_alignment": op12_alignment,
    "op13_simhash": op13_simhash,
}
SQL = {
    "op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op3_ngram_join": OP3_SQL, "op5_decontamination": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op9_mixing": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
}
