"""Requirement-to-code mapping: retrieval, rerank threshold, judgement, grounding, fallbacks, callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths
from ..functions.text import head_tail, strip
from .retrieval import bm25, knn, top_k

SCOPE = ["organization_id", "repository_id"]

# Cut-offs, thresholds and reasons.
CANDIDATES, JUDGED, MIN_CHARS, THRESHOLD, HIGH_MARGIN = 20, 5, 100, 0.5, 1.5
NO_RANK = 999
REASON_EMPTY = "Business text is empty."
REASON_NONE = "No code candidates found in repository."
REASON_BELOW = "No code chunk scored above the reranking threshold (0.5) for this business concept."
REASON_UNCONFIRMED = "No code candidate was confirmed as a match for this business requirement by the judge."
REASONING_DISABLED = "Mapped using cross-encoder rerank score (LLM judge disabled)."
REASONING_UNAVAILABLE = "LLM provider unavailable; mapped using cross-encoder rerank score."
REASONING_UNPARSEABLE = "LLM judge response unparseable; retained top cross-encoder candidate with low confidence."
REASONING_FILE = r"\b[a-zA-Z0-9_\-]+\.(?:py|js|ts|jsx|tsx|md|rst|txt)\b"
JUDGEMENT = "array<struct<candidate_id int, match boolean, confidence string, reasoning string>>"


def candidates(chunks: DataFrame, requirements: DataFrame, embedded: DataFrame | None = None, k: int = CANDIDATES) -> DataFrame:
    """(scope, query_id, chunk_id, vector_rank, keyword_rank, position): best ``k`` by vector rank, then keyword rank.

    ``requirements`` are queries (scope, query_id, query_text[, embedding]); only chunks of the same
    tenant and repository take part, statistics included.
    """
    words = bm25(chunks, requirements, SCOPE, k).select(*SCOPE, "query_id", "chunk_id", "keyword_rank")
    if embedded is not None:
        near = knn(embedded, requirements, SCOPE, k).select(*SCOPE, "query_id", "chunk_id", "vector_rank")
        both = near.join(words, [*SCOPE, "query_id", "chunk_id"], "full_outer")
    else:
        both = words.withColumn("vector_rank", F.lit(None).cast("int"))
    order = [F.coalesce("vector_rank", F.lit(NO_RANK)), F.coalesce("keyword_rank", F.lit(NO_RANK)), F.col("chunk_id")]
    return top_k(both, [*SCOPE, "query_id"], order, k, "position")


def rerank_candidates(found: DataFrame, provider: str = "stub", score_udf=None, requirements: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Scores: the stub counts down from the number of candidates; a failed model falls by a tenth per place.

    A model (``score_udf(query_text, text)``) reads the requirement and head and tail of the chunk, which are looked up in
    ``requirements`` and ``chunks``.
    """
    columns = found.columns
    if score_udf is not None:
        if requirements is None or chunks is None:
            raise ValueError("a model needs the requirements and the chunks")
        provider = "model"
        asked = requirements.select(*SCOPE, "query_id", "query_text")
        texts = chunks.select(*SCOPE, F.col("chunk_id").cast("string").alias("chunk_id"), head_tail("text").alias("_text"))
        found = found.join(asked, [*SCOPE, "query_id"]).join(texts, [*SCOPE, "chunk_id"])
    size = F.count(F.lit(1)).over(Window.partitionBy(*SCOPE, "query_id"))
    fallback = 1.0 - (F.col("position") - 1) * 0.1
    if provider == "stub":
        score = (size - F.col("position") + 1).cast("double")
    elif score_udf is None:
        score = fallback
    else:
        score = F.coalesce(score_udf(F.col("query_text"), F.col("_text")).cast("double"), fallback)
    return found.withColumn("rerank_score", score).select(*columns, "rerank_score")


def survivors(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    kept = scored.where(F.col("rerank_score") >= threshold)
    return top_k(kept, [*SCOPE, "query_id"], [F.desc("rerank_score"), F.asc("position")], None, "rank")


def confidence_without_judge(score, threshold: float = THRESHOLD) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > threshold + HIGH_MARGIN, "high").when(s >= threshold, "medium").otherwise("low")


def parse_judgements(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parsed, items): fences stripped, a list or an object with ``candidates``; else not parsed."""
    raw = strip("raw_response")
    raw = F.regexp_replace(F.regexp_replace(raw, r"^```(?:json)?", ""), r"```\z", "")
    raw = strip(raw)
    items = F.when(raw.startswith("["), F.from_json(raw, JUDGEMENT)).when(
        raw.startswith("{"), F.from_json(raw, f"candidates {JUDGEMENT}")["candidates"])
    return responses.withColumn("items", items).withColumn("parsed", F.col("items").isNotNull()).select(*keys, "parsed", "items")


def target_type(function_name) -> Column:
    f = F.col(function_name) if isinstance(function_name, str) else function_name
    return F.when(F.coalesce(f, F.lit("")) != "", "function").otherwise("file")


def judge(top: DataFrame, responses: DataFrame, keys: list[str], max_mappings: int = 5) -> DataFrame:
    """Confirmed mappings per request.

    ``top`` has keys, candidate_id (0-based, at most five per request), file_path, function_name and
    rerank_score.  File names in a reasoning that no candidate has (and that are not tests) turn high
    confidence to medium and flag the request; unparsed answers keep the candidates at low confidence,
    missing answers at medium.
    """
    answers = parse_judgements(responses, keys)
    known = top.groupBy(*keys).agg(F.array_union(
        F.collect_set(F.lower("file_path")), F.collect_set(F.lower(paths.name("file_path")))).alias("_known"))
    said = answers.where("parsed").select(*keys, F.explode("items").alias("_a")).select(*keys, "_a.*")
    named = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("reasoning"), F.lit(REASONING_FILE), 0)), lambda f: ~f.startswith("test"))
    conf = F.lower(F.coalesce("confidence", F.lit("medium")))
    said = said.where(F.coalesce("match", F.lit(False)) & (conf != "none")).withColumn("confidence", conf)
    said = said.join(known, keys).withColumn("_odd", F.size(F.array_except(named, "_known")) > 0).drop("_known")
    final = F.when(F.col("_odd") & (F.col("confidence") == "high"), "medium").when(
        F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium")
    cols = [*keys, "candidate_id", "file_path", "function_name", "rerank_score", "confidence", "evidence_type", "reasoning", "warned"]
    confirmed = said.join(top, [*keys, "candidate_id"]).withColumns({
        "confidence": final, "evidence_type": F.lit("llm_reasoning"), "warned": F.col("_odd"),
        "reasoning": F.coalesce(F.nullif(F.trim("reasoning"), F.lit("")), F.lit("Confirmed by LLM judge."))}).select(cols)
    state = top.select(*keys).distinct().join(answers.select(*keys, "parsed"), keys, "left").where("parsed is null or not parsed")
    fallback = top.join(state, keys).withColumns({
        "confidence": F.when(F.col("parsed").isNull(), "medium").otherwise("low"), "evidence_type": F.lit("reranker_only"),
        "reasoning": F.when(F.col("parsed").isNull(), REASONING_UNAVAILABLE).otherwise(REASONING_UNPARSEABLE), "warned": F.lit(True)}).select(cols)
    kept = top_k(confirmed.unionByName(fallback), keys, [F.asc("candidate_id")], max_mappings, "mapping")
    return kept.withColumns({
        "target_type": target_type("function_name"),
        "low_confidence": (F.col("confidence") == "low") | (F.col("warned") & (F.col("evidence_type") == "llm_reasoning"))})


def outcomes(requirements: DataFrame, found: DataFrame, kept: DataFrame, mapped: DataFrame) -> DataFrame:
    """Stage counts and the reason a requirement stayed unmapped."""
    keys = [*SCOPE, "query_id"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    rows = requirements.select(*keys, "query_text").join(n(found, "stage1_candidates"), keys, "left").join(
        n(kept, "stage2_survivors"), keys, "left").join(n(mapped, "stage3_confirmed"), keys, "left")
    rows = rows.fillna(0, ["stage1_candidates", "stage2_survivors", "stage3_confirmed"])
    reason = (
        F.when(strip("query_text") == "", REASON_EMPTY).when(F.col("stage1_candidates") == 0, REASON_NONE)
        .when(F.col("stage2_survivors") == 0, REASON_BELOW).when(F.col("stage3_confirmed") == 0, REASON_UNCONFIRMED))
    return rows.withColumn("unmapped_reason", reason).drop("query_text")


def usable_chunks(chunks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Business chunks long enough to map, with the reason for the skipped ones."""
    short = (F.length(strip("text")) < min_chars) | F.coalesce("is_stub_or_empty", F.lit(False))
    return chunks.withColumn("skip_reason", F.when(short, F.lit("Chunk text too short or empty (PDF page boundary fragment).")))


def document_summary(chunk_outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: chunks mapped, unmapped, skipped, and the worst quality."""
    return chunk_outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("mappings") > 0).alias("chunks_mapped"),
        F.count_if(F.col("mappings") == 0).alias("chunks_unmapped"), F.count_if(F.col("skipped")).alias("chunks_skipped"),
        F.when(F.bool_or(F.coalesce("warned", F.lit(False))), "grounding_warning").otherwise("ok").alias("overall_generation_quality"))


def check_request(chunk_id: str | None, business_text: str | None) -> None:
    """Exactly one of the two inputs is accepted."""
    if bool((chunk_id or "").strip()) == bool((business_text or "").strip()):
        raise ValueError("Provide either chunk_id or business_text, and only one of them.")
