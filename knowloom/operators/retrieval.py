"""Keyword, vector and fused retrieval for many queries and many tenants in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col
from . import keyword_index, substrings, vector_cells
from .keyword_index import KeywordIndex
from .vector_cells import VectorCells

# Fusion constant, stage cut-offs.
RRF_K = 60
VECTOR_TOP, KEYWORD_TOP, RERANK_POOL = 50, 100, 30


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str) -> DataFrame:
    """Dense 1-based rank per key, cut at ``k``; the partial cut runs before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


# ---------------------------------------------------------------- keyword search


def bm25(chunks: DataFrame | KeywordIndex, queries: DataFrame, scope: list[str] = ["organization_id"], k: int | None = KEYWORD_TOP) -> DataFrame:
    """(scope, query_id, chunk_id, keyword_score, keyword_rank) for the positive Okapi scores.

    ``chunks``: scope columns, chunk_id, text, or a :class:`KeywordIndex` of them, which serves any number of searches.
    ``queries``: scope columns, query_id, query_text.  Corpus statistics follow whatever filters were applied to
    ``chunks``.  Postings meet the questions' terms where they lie, move once to their segment's task, and come out as
    ``k`` rows a question and segment, which are merged per question.
    """
    index = chunks if isinstance(chunks, KeywordIndex) else keyword_index.build(chunks, scope)
    found = keyword_index.search(index, queries, k)
    return top_k(found, [*index.scope, "query_id"], [F.desc("keyword_score"), F.asc("chunk_id")], k, "keyword_rank")


# ---------------------------------------------------------------- vector search


def similarity(distance) -> Column:
    """Score of a distance: one minus it, never below zero, four places."""
    return F.round(F.greatest(F.lit(0.0), 1 - col(distance)), 4)


def knn(chunks: DataFrame | VectorCells, queries: DataFrame, scope: list[str] = ["organization_id"], k: int = VECTOR_TOP) -> DataFrame:
    """Exact k nearest chunks per query: (scope, query_id, chunk_id, distance, vector_rank), ties by chunk_id.

    ``chunks``: scope columns, chunk_id, embedding, or :class:`VectorCells` of them, which serve any number of searches.
    The vectors are read once, however many queries there are; queries and chunks of different lengths do not meet.
    """
    index = chunks if isinstance(chunks, VectorCells) else vector_cells.build(chunks, scope)
    found = vector_cells.nearest(index, queries, k)
    return top_k(found, [*index.scope, "query_id"], [F.asc("distance"), F.asc("chunk_id")], k, "vector_rank")


def merge_collections(code: DataFrame, docs: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Rank the hits of both collections together by score; of an id found in both, the code hit stays."""
    both = code.withColumn("collection", F.lit(0)).unionByName(docs.withColumn("collection", F.lit(1)))
    best = both.groupBy(*keys, "chunk_id").agg(F.min(F.struct("collection", "distance")).alias("_h")).select(
        *keys, "chunk_id", "_h.*").withColumn("similarity_score", similarity("distance"))
    order = [F.desc("similarity_score"), F.asc("collection"), F.asc("distance"), F.asc("chunk_id")]
    return top_k(best, keys, order, k, "vector_rank").withColumn("result_type", F.when(F.col("collection") == 0, "code").otherwise("doc")).drop("collection")


# ---------------------------------------------------------------- fusion, pools, pages


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two rankings with the fused score and its rank (ties by chunk_id)."""
    fused = vector.join(keyword, [*keys, "chunk_id"], "full_outer")
    part = lambda rank: F.coalesce(1 / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))
    fused = fused.withColumn("rrf_score", F.round(part("vector_rank") + part("keyword_rank"), 6))
    return top_k(fused, keys, [F.desc("rrf_score"), F.asc("chunk_id")], None, "rrf_rank")


def rerank_pool(fused: DataFrame, limit: int, offset: int = 0, pool: int = RERANK_POOL) -> DataFrame:
    return fused.where(F.col("rrf_rank") <= max(pool, limit + offset))


def rerank(pool: DataFrame, keys: list[str], provider: str = "stub", score_udf=None) -> DataFrame:
    """Rerank score per pooled row: the stub counts down from the pool size; ``disabled`` gives none.

    A model provider passes ``score_udf(query_text, text)``, a pandas UDF as :func:`providers.model_scores` makes;
    rows it cannot score come after the others in the fused order.
    """
    if provider not in ("stub", "disabled") and score_udf is None:
        raise ValueError(f"provider {provider!r} needs a score_udf")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    if provider == "stub":
        scored = pool.withColumn("rerank_score", (size - F.col("rrf_rank") + 1).cast("double"))
    elif provider == "disabled":
        scored = pool.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        scored = pool.withColumn("rerank_score", score_udf(F.col("query_text"), F.col("text")).cast("double"))
    return top_k(scored, keys, [F.desc_nulls_last("rerank_score"), F.asc("rrf_rank")], None, "final_rank")


def page(ranked: DataFrame, keys: list[str], limit: int, offset: int = 0, rank: str = "final_rank") -> DataFrame:
    """One page per query with the size of the pool it was cut from."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ranked.withColumn("total_results", total).where(F.col(rank).between(offset + 1, offset + limit))


def chunk_filter(org, module_id=None, doc_type=None, repository_id=None, source_type: str = "all") -> Column:
    """Tenant predicate first, then the optional metadata filters; doc_type binds documents only."""
    cond = F.col("organization_id") == F.lit(org)
    if module_id:
        cond = cond & (F.col("module_id") == F.lit(module_id))
    if repository_id:
        cond = cond & (F.col("repository_id") == F.lit(repository_id))
    if source_type != "all":
        cond = cond & (F.col("source_type") == F.lit(source_type))
    if doc_type:
        cond = cond & ((F.col("source_type") != "doc") | (F.col("doc_type") == F.lit(doc_type)))
    return cond


# The ordered question patterns, first match wins.
INTENT_PATTERNS = (
    ("SAME_MODULE_FUNCTIONS", r"(?:what\s+|list\s+|show\s+|are\s+there\s+)?(?:other\s+)?functions?\s+(?:are\s+in|exist\s+in|are\s+there\s+in|in)?\s*(?:the\s+)?same\s+module\s+as\s+([\w\-]+)"),
    ("SAME_MODULE_FUNCTIONS", r"siblings?\s+of\s+(?:function\s+)?([\w\-]+)"),
    ("SAME_MODULE_FUNCTIONS", r"what\s+else\s+is\s+in\s+the\s+same\s+module\s+as\s+([\w\-]+)"),
    ("SAME_FILE_FUNCTIONS", r"(?:what\s+|list\s+|show\s+|are\s+there\s+)?(?:other\s+)?functions?\s+(?:are\s+in|exist\s+in|are\s+there\s+in|in)?\s*(?:the\s+)?same\s+file\s+as\s+([\w\-]+)"),
    ("SAME_FILE_FUNCTIONS", r"functions?\s+defined\s+alongside\s+([\w\-]+)"),
    ("FILE_SYMBOLS", r"(?:what\s+)?(?:functions?|classes?|symbols?)\s+(?:are\s+)?in\s+([\w\.\/\-]+\.py)"),
    ("FILE_SYMBOLS", r"(?:show|list)\s+(?:me\s+)?(?:the\s+)?(?:functions?|classes?|contents?\s+of\s+)?([\w\.\/\-]+\.py)"),
    ("FILE_SYMBOLS", r"what(?:'s|\s+is)\s+in\s+([\w\.\/\-]+\.py)"),
    ("FILE_SYMBOLS", r"symbols?\s+in\s+([\w\.\/\-]+\.py)"),
    ("CONTAINING_FILE", r"(?:which|what)\s+file\s+(?:contains?|has|defines?)\s+(?:function\s+|class\s+)?([\w\-]+)"),
    ("CONTAINING_FILE", r"where\s+is\s+(?:function\s+|class\s+)?([\w\-]+)\s+defined"),
    ("CONTAINING_FILE", r"file\s+location\s+of\s+([\w\-]+)"),
    ("CONTAINING_MODULE", r"(?:which|what)\s+module\s+(?:contains?|has|is)\s+([\w\.\/\-]+(?:\.py)?)\s*(?:in)?"),
)


def classify_intent(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Add intent and entity_name (null for SEMANTIC) to every question."""
    clean = F.trim(F.col(text))
    intent, entity = F.lit("SEMANTIC"), F.lit(None).cast("string")
    for label, pattern in reversed(INTENT_PATTERNS):
        hit = clean.rlike("(?iU)" + pattern)
        intent = F.when(hit, F.lit(label)).otherwise(intent)
        entity = F.when(hit, F.regexp_extract(clean, "(?iU)" + pattern, 1)).otherwise(entity)
    return queries.withColumns({"intent": intent, "entity_name": F.regexp_replace(entity, r"\(\)$", "")})


def file_id_of(module_id, file_path, file_id=None) -> Column:
    """Explicit file id, else the repository prefix of the module id, else a bare file key."""
    derived = F.when(
        F.instr(col(module_id), ":module:") > 0,
        F.concat(F.substring_index(col(module_id), ":module:", 1), F.lit(":file:"), col(file_path)),
    ).otherwise(F.concat(F.lit("file:"), col(file_path)))
    return derived if file_id is None else F.coalesce(F.nullif(col(file_id), F.lit("")), derived)


def doc_id_of(doc_id, relative_path) -> Column:
    """Explicit document id, else a key made from its path, else null."""
    path = F.nullif(col(relative_path), F.lit(""))
    return F.coalesce(F.nullif(col(doc_id), F.lit("")), F.concat(F.lit("doc:"), path))


# The metadata columns a search result may show, with their defaults.
CODE_METADATA = {
    "file_path": "", "function_name": "", "class_name": "", "parent_class": "", "start_line": 0, "end_line": 0,
    "chunk_type": "unknown", "language": "", "token_count": 0, "is_documented": False,
}
DOC_METADATA = {
    "relative_path": "", "heading_path": "", "section_level": 0, "chunking_method": "", "chunk_type": "unknown",
    "chunk_total": 0, "file_format": "", "version": 1, "token_count": 0, "has_code_fence": False, "doc_type": "",
    "repository_id": "",
}


def shown_metadata(chunks: DataFrame, allowed: dict, keep: list[str]) -> DataFrame:
    """Project the allowed metadata columns, filling absent columns and nulls with their defaults."""
    cols = [
        (F.coalesce(F.col(n), F.lit(d)) if n in chunks.columns else F.lit(d)).alias(n)
        for n, d in allowed.items()
    ]
    return chunks.select(*keep, *cols)


def literal_search(files: DataFrame, needles: DataFrame, max_results: int | None = 50, max_chars: int | None = None) -> DataFrame:
    """Case-insensitive literal line search: (query_id, path, line, text) for the first hits in path order.

    Any number of needles (query_id, needle) is one plan: lines meet a needle by its rarest gram. ``max_results`` and
    ``max_chars`` (of a shown line) are choices of the caller; None shows all.
    """
    asked = needles.select("query_id", F.lower(F.trim("needle")).alias("needle")).where(F.col("needle") != "").distinct()
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("_n", "_line"))
    shown = F.col("_line") if max_chars is None else F.left("_line", F.lit(max_chars))
    found = substrings.find(rows.select("path", "_n", F.lower("_line").alias("text")), asked, ["path", "_n"])
    hits = rows.join(found.join(asked, "needle"), ["path", "_n"]).select("query_id", "path", (F.col("_n") + 1).alias("line"), shown.alias("text"))
    return top_k(hits, ["query_id"], [F.asc("path"), F.asc("line")], max_results, "hit").drop("hit")


def lookup_symbols(symbols: DataFrame, names: DataFrame, max_results: int | None = 25) -> DataFrame:
    """Symbols by exact qualified name, else by name whatever its case."""
    exact = symbols.join(names, symbols["qualified_name"] == names["symbol_name"]).withColumn("_p", F.lit(0))
    loose = symbols.join(names, F.lower(symbols["name"]) == F.lower(names["symbol_name"])).withColumn("_p", F.lit(1))
    both = exact.unionByName(loose)
    best = both.groupBy("symbol_name").agg(F.min("_p").alias("_p"))
    found = both.join(best, ["symbol_name", "_p"]).drop("_p")
    return top_k(found, ["symbol_name"], [F.asc("file"), F.asc("start_line"), F.asc("qualified_name")], max_results, "position")
