"""Queries of this package by name, and the SQL for those that SQL can express."""

from loomfill.llm.ann import op5_nearest_neighbours
from loomfill.llm.bpe import op10_bpe
from loomfill.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from loomfill.llm.jaccard import OP4_SQL, op4_ngram_jaccard
from loomfill.llm.mixing import op1_mixing
from loomfill.llm.quality import op8_quality
from loomfill.llm.repeats import OP6_SQL, op6_repeated_strings
from loomfill.llm.sharding import op3_sharding, op3_sql
from loomfill.llm.token_counts import op7_token_counts
from loomfill.llm.url_filter import OP2_SQL, op2_url_filters

QUERIES = {f.__name__: f for f in (op1_mixing, op2_url_filters, op3_sharding, op4_ngram_jaccard, op5_nearest_neighbours, op6_repeated_strings, op7_token_counts, op8_quality, op9_exact_dedup, op10_bpe)}

ORACLE_SQL = {"op2_url_filters": OP2_SQL, "op3_sharding": op3_sql(), "op4_ngram_jaccard": OP4_SQL, "op6_repeated_strings": OP6_SQL, "op9_exact_dedup": OP9_SQL}
