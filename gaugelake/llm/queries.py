"""The registered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from gaugelake.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from gaugelake.llm.decontaminate import op5_benchmark_decontamination
from gaugelake.llm.fingerprints import op2_fingerprints
from gaugelake.llm.hash_forest import op13_nearest_neighbours
from gaugelake.llm.ngram_join import op4_ngram_jaccard_join
from gaugelake.llm.packing import op1_packing
from gaugelake.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from gaugelake.llm.quality import op3_quality
from gaugelake.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from gaugelake.llm.suffix_dedup import op6_suffix_dedup
from gaugelake.llm.token_rollups import OP8_SQL, op8_token_rollups
from gaugelake.llm.toxicity import op9_toxicity
from gaugelake.llm.url_filter import op7_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_fingerprints, op3_quality, op4_ngram_jaccard_join, op5_benchmark_decontamination, op6_suffix_dedup,
        op7_url_filters,
        op8_token_rollups, op9_toxicity, op10_substring_dedup,
        op11_periodic_runs, op12_conversation_repair, op13_nearest_neighbours,
    )
}
ORACLES: dict[str, str] = {"op8_token_rollups": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_conversation_repair": OP12_SQL}
