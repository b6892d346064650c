"""Document and code chunkers that need no Python: windows, headers, documentation flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import approx_tokens, col, content_hash, has_code_fence, is_blank, strip

# Window sizes in characters.
DOC_WINDOW, DOC_OVERLAP = 2000, 300
CODE_WINDOW, CODE_OVERLAP = 800, 100
CODE_CHUNK_MAX = 3000


def fixed_window_slices(text: Column, window: int = DOC_WINDOW, overlap: int = DOC_OVERLAP, gapless: bool = True) -> Column:
    """Array of (start_char, end_char, body) windows of one text; blank windows left out.

    A window that does not reach the end of the text is pulled back to the last paragraph break, else
    the last line break, in its second half, but not before the next start, so that every character
    is in some window.  Without ``gapless`` it is pulled back all the way, and characters up to the
    next start may be lost.  Each step is its own transform, so nothing is computed twice in a lambda.
    """
    text = col(text)
    step = window - overlap if window > overlap else window
    offset = step // 2
    total = F.length(text)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(step)),
        lambda s: (s == 0) | (s + (window - step) < total),
    )
    zones = F.transform(starts, lambda s: F.struct(
        s.alias("s"),
        F.when(s + window < total, F.reverse(F.substr(text, s + offset + 1, F.lit(window - offset)))).alias("back")))
    seams = F.transform(zones, lambda z: F.struct(
        z["s"].alias("s"),
        F.coalesce(F.nullif(F.instr(z["back"], "\n\n"), F.lit(0)), F.nullif(F.instr(z["back"], "\n"), F.lit(0))).alias("seam")))
    pulled = lambda z: z["s"] + window + 1 - z["seam"]
    ends = F.transform(seams, lambda z: F.struct(
        z["s"].alias("s"),
        F.coalesce(F.when(z["seam"].isNotNull(), F.greatest(pulled(z), z["s"] + step)) if gapless else pulled(z), F.least(z["s"] + window, total)).alias("e")))
    cut = F.transform(ends, lambda w: F.struct(
        w["s"].alias("start_char"), w["e"].alias("end_char"), F.substr(text, w["s"] + 1, w["e"] - w["s"]).alias("body")))
    return F.filter(cut, lambda w: ~is_blank(w["body"]))


def document_header(filename, section, index, total) -> Column:
    return F.format_string("# Document: %s\n# Section: %s\n# Chunk: %d/%d\n", col(filename), col(section), col(index) + 1, col(total))


def fixed_window_chunks(docs: DataFrame, window: int = DOC_WINDOW, overlap: int = DOC_OVERLAP, gapless: bool = True) -> DataFrame:
    """Rows (doc_id, filename, text, …) to one row per window, without a shuffle.

    Windows are built, numbered and counted inside the row, so a document never leaves its task.
    """
    keep = [c for c in docs.columns if c != "text"]
    sliced = docs.select(*keep, fixed_window_slices(F.col("text"), window, overlap, gapless).alias("_w"))
    rows = sliced.select(*keep, F.size("_w").alias("chunk_total"), F.posexplode_outer("_w").alias("chunk_index", "_c")).where(
        F.col("_c").isNotNull())
    body = strip("_c.body")
    text = F.concat(document_header("filename", F.lit("root"), "chunk_index", "chunk_total"), F.lit("\n"), body)
    return rows.select(
        *keep, F.concat("doc_id", F.lit(":chunk:"), "chunk_index").alias("chunk_id"),
        "chunk_index", "chunk_total", "_c.start_char", "_c.end_char", text.alias("text"),
        F.lit("fixed_window").alias("chunking_method"),
    ).withColumns({"has_code_fence": has_code_fence("text"), "content_hash": content_hash("text")})


def code_window_chunks(files: DataFrame, window: int = CODE_WINDOW, overlap: int = CODE_OVERLAP) -> DataFrame:
    """Fallback code chunks (file_id, path, text, …): constant windows with line spans."""
    keep = [c for c in files.columns if c != "text"]
    text, step = F.col("text"), window - overlap
    total = F.length(text)

    def cut(s: Column) -> Column:
        end = F.least(s + window, total)

        def line_at(n: Column) -> Column:
            before = F.left(text, n)
            return n - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1

        return F.struct(
            F.substr(text, s + 1, end - s).alias("body"), line_at(s).alias("start_line"), line_at(end).alias("end_line")
        )

    starts = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(step))
    windows = F.filter(F.transform(starts, cut), lambda w: ~is_blank(w["body"]))
    rows = files.select(*keep, windows.alias("_w")).select(
        *keep, F.size("_w").alias("chunk_total"), F.posexplode_outer("_w").alias("_i", "_c")
    ).where(F.col("_c").isNotNull())
    header = F.format_string("# File: %s\n# Chunk: %d/%d\n", F.col("path"), F.col("_i") + 1, F.col("chunk_total"))
    return rows.select(
        *keep, F.concat("file_id", F.lit("-chunk-"), F.col("_i") + 1).alias("chunk_id"),
        (F.col("_i") + 1).alias("chunk_number"), "chunk_total", "_c.start_line", "_c.end_line",
        F.concat(header, F.lit("\n"), "_c.body").alias("text"), F.lit("fixed_window").alias("chunk_type"),
    )


def split_giant_chunks(chunks: DataFrame, max_chars: int = CODE_CHUNK_MAX, overlap: int = 100) -> DataFrame:
    """Slide over the body of chunks whose header + body exceed the ceiling; others pass through.

    Input: chunk_id, file_id, header, body, function_name, class_name, start_line, …
    """
    whole = F.concat("header", F.lit("\n"), "body")
    size = F.greatest(F.lit(max_chars) - F.length("header") - 50, F.lit(500))
    starts = F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), size - overlap)
    pieces = F.filter(F.transform(starts, lambda s: F.substr(F.col("body"), s + 1, size)), lambda p: ~is_blank(p))
    tag = F.coalesce(F.nullif("function_name", F.lit("")), F.nullif("class_name", F.lit("")), F.lit("body"))
    keep = [c for c in chunks.columns if c not in ("chunk_id", "header", "body")]
    rows = chunks.select(
        *keep, "header", "chunk_id",
        F.posexplode(F.when(F.length(whole) > max_chars, pieces).otherwise(F.array("body"))).alias("_p", "_b"),
        (F.length(whole) > max_chars).alias("is_part"),
    )
    part_id = F.concat("file_id", F.lit("-fn-"), tag, F.lit("-"), "start_line", F.lit("-part-"), F.col("_p") + 1)
    return rows.select(
        *keep, F.when(F.col("is_part"), part_id).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.concat("header", F.lit("\n"), "_b").alias("text"), "is_part",
    )


# Line starts that belong to a signature, and those that open documentation.
SIGNATURE_START = (
    r"^(def |async def |class |@|function |async function |constructor|get |set |"
    r"public |private |protected |static |export )"
)
DOCUMENTATION_START = r"^(\"\"\"|'''|//|/\*|#)"


def is_documented(text, header_lines: int) -> Column:
    """Whether the first body line that is neither blank nor a signature opens documentation."""
    body = F.slice(F.split(col(text), "\n"), header_lines + 1, 1_000_000_000)
    told = F.filter(F.transform(body, strip), lambda s: (s != "") & ~s.rlike(SIGNATURE_START))
    return F.coalesce(F.get(told, F.lit(0)).rlike(DOCUMENTATION_START), F.lit(False))


def chunk_tenant_key(org, repository, path, function_name, class_name, chunk_id) -> Column:
    base = F.concat(col(org), F.lit(":"), col(repository))
    in_file = F.concat(base, F.lit("/"), col(path))
    return (
        F.when(F.coalesce(col(function_name), F.lit("")) != "", F.concat(in_file, F.lit("::"), col(function_name)))
        .when(F.coalesce(col(class_name), F.lit("")) != "", F.concat(in_file, F.lit("::"), col(class_name)))
        .otherwise(F.concat(in_file, F.lit(":"), col(chunk_id)))
    )


def chunk_metrics(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumns({"approx_tokens": approx_tokens(text), "has_code_fence": has_code_fence(text), "content_hash": content_hash(text)})
