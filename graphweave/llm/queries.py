"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from graphweave.llm.byte_bpe import op9_byte_bpe
from graphweave.llm.fingerprints import op6_fingerprints
from graphweave.llm.language_id import op3_language_id
from graphweave.llm.ngram_join import op2_ngram_jaccard_join
from graphweave.llm.packing import op8_best_fit_packing
from graphweave.llm.quality import op5_quality_classifier
from graphweave.llm.secrets import op4_secret_scan
from graphweave.llm.token_counts import op1_token_counts
from graphweave.llm.token_files import op7_token_files
from graphweave.llm.topk import op10_exact_top_k

#: Queries by inner product: all pairs of the query set and the table are scored, in exact integers.
TOP_K_SQL = """
with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
           where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q::double[], b.q::double[]) as bigint) as score
           from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_language_id": op3_language_id,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_fingerprints": op6_fingerprints,
        "op7_token_files": op7_token_files,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_exact_top_k": op10_exact_top_k,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_top_k": TOP_K_SQL}
