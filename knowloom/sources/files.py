"""File sources and sinks: source trees, documents, commit logs, artifacts."""

from __future__ import annotations

import hashlib
import io
import os
import subprocess
import zipfile
import xml.etree.ElementTree as xml

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths
from ..operators.render import LINE_COLUMNS
from ..operators.source_facts import REPO

# Field and record marks of the log format, bundle ceiling, heading styles.
LOG_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%cI%x1f"
BUNDLE_BYTES = 100 * 1024 * 1024
DOCX_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def clean_utf8(content) -> Column:
    """Bytes as text; bytes that are no UTF-8 are left out. A text that is valid stays as it is, replacement characters included."""
    c = (F.col(content) if isinstance(content, str) else content).cast("string")
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit("")))


def read_tree(spark: SparkSession, root: str, organization_id: str, repository_id: str) -> DataFrame:
    """Every file under a folder: (tenant, repository, path, size_bytes, has_nul, content)."""
    base = "file:" + os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(base.replace("file:///", "file:/")), F.lit(""))
    nul = F.instr(F.hex(F.substring("content", 1, 4096)), "00")
    return raw.select(
        F.lit(organization_id).alias("organization_id"), F.lit(repository_id).alias("repository_id"), rel.alias("path"),
        F.col("length").alias("size_bytes"), ((nul > 0) & F.hex(F.substring("content", 1, 4096)).rlike("^(?:..)*00")).alias("has_nul"), "content")


def with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", clean_utf8("content")).drop("content")


def docx_markdown(data: bytes) -> str:
    """Paragraphs of a word-processor file; heading styles 1, 2 and 3 or deeper become #, ## and ###."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = xml.fromstring(z.read("word/document.xml"))
        named = {}
        if "word/styles.xml" in z.namelist():
            for s in xml.fromstring(z.read("word/styles.xml")).iter(DOCX_NS + "style"):
                label = s.find(DOCX_NS + "name")
                named[s.get(DOCX_NS + "styleId")] = (label.get(DOCX_NS + "val") if label is not None else "") or ""
    out = []
    for p in body.iter(DOCX_NS + "p"):
        text = "".join(t.text or "" for t in p.iter(DOCX_NS + "t")).strip()
        mark = p.find(f"{DOCX_NS}pPr/{DOCX_NS}pStyle")
        style = mark.get(DOCX_NS + "val") if mark is not None else ""
        style = named.get(style, style).lower().replace("heading ", "heading")
        depth = next((min(n, 3) for n in range(1, 10) if f"heading{n}" in style), 0)
        if text:
            out.append("#" * depth + " " * bool(depth) + text)
    return "\n\n".join(out)


def read_documents(files: DataFrame) -> DataFrame:
    """(…, text, chunking_method) of document files: Markdown and word-processor files by heading, others by window.

    Page-wise files are left to ``read_pages``; a damaged word-processor file has a null text and the method ``unreadable``.
    """
    ext = F.lower(paths.suffix("path"))
    keep = [c for c in files.columns if c != "content"]
    plain = files.where(~ext.isin(".docx", ".pdf")).select(*keep, clean_utf8("content").alias("text"), F.when(ext == ".md", "heading_aware").otherwise("fixed_window").alias("chunking_method"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")

    def read(batches):
        for batch in batches:
            texts, ways = [], []
            for data in batch["content"]:
                try:
                    texts.append(docx_markdown(bytes(data)))
                    ways.append("heading_aware")
                except (zipfile.BadZipFile, KeyError, xml.ParseError):
                    texts.append(None)
                    ways.append("unreadable")
            yield pd.DataFrame(batch[keep]).assign(text=texts, chunking_method=ways)

    word = files.where(ext == ".docx").select(*keep, "content").mapInPandas(read, f"{fields}, text string, chunking_method string")
    return plain.unionByName(word)


def read_pages(files: DataFrame) -> DataFrame:
    """(tenant, repository, path, page_no, text) of page-wise files, for ``headings.page_headings``.

    Needs the optional pypdf; without it, or for a file it cannot read, there is one page with a null text.
    """
    keys = [*REPO, "path"]

    def pages(data: bytes) -> list[str | None]:
        try:
            import pypdf

            texts = [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(data)).pages]
            return [t for t in texts if t]
        except Exception:  # no reader, or damaged input
            return [None]

    def read(batches):
        for batch in batches:
            rows = [(o, r, p, i, t) for o, r, p, data in batch.itertuples(index=False) for i, t in enumerate(pages(bytes(data)))]
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "page_no", "text"])

    src = files.where(F.lower(paths.suffix("path")) == ".pdf").select(*keys, "content")
    return src.mapInPandas(read, "organization_id string, repository_id string, path string, page_no int, text string")


# ------------------------------------------------------------------ checkouts and commit history


def checkout(address: str, target: str, ref: str | None = None, depth: int | None = None) -> str:
    """Clone an already validated address (``paths.repository_url_problem``, ``paths.git_ref_ok``) and return its commit.

    With a ref only that commit is fetched.  Nothing of the repository is run.
    """
    git = lambda *args: subprocess.run(["git", *args], check=True, capture_output=True, text=True).stdout.strip()
    if ref:
        git("init", "-q", target)
        git("-C", target, "fetch", "-q", "--depth=1", "--no-tags", "--", address, ref)
        git("-C", target, "checkout", "-q", "--detach", "FETCH_HEAD")
    else:
        git("clone", "-q", *([] if depth is None else [f"--depth={int(depth)}"]), "--no-tags", "--", address, target)
    return git("-C", target, "rev-parse", "HEAD")


def write_git_log(checkout: str, target: str, max_commits: int | None = None) -> None:
    """Save the log of a local checkout in the record format ``read_commits`` takes."""
    log = subprocess.run(["git", "-C", checkout, "log", *([] if max_commits is None else [f"-{int(max_commits)}"]), "--name-only", f"--pretty=format:{LOG_FORMAT}"], check=True, capture_output=True)
    with open(target, "wb") as out:
        out.write(log.stdout)


def read_commits(spark: SparkSession, logs: str, organization_id: str, repository_id: str) -> DataFrame:
    """One row per (commit, touched path); Spark splits the log at its record marks."""
    raw = spark.read.option("lineSep", "\x1e").text(logs).where(F.col("value").contains("\x1f"))
    f = F.split("value", "\x1f")
    rows = raw.select(f[0].alias("sha"), f[1].alias("author_name"), f[2].alias("author_email"), F.to_timestamp(f[3]).alias("committed_at"),
                      F.explode(F.filter(F.split(f[4], r"\r?\n"), lambda p: p != "")).alias("path"))
    return rows.select(F.lit(organization_id).alias("organization_id"), F.lit(repository_id).alias("repository_id"), "*")


# ------------------------------------------------------------------ sinks


def write_artifact(df: DataFrame, path: str) -> None:
    """JSON lines, fields in name order; the committer makes the write all or nothing."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_documents(document_lines: DataFrame, path: str) -> None:
    """One folder per document, its lines in order; lines are sorted by Spark and never gathered."""
    keys = [*REPO, "document_id"]
    ordered = document_lines.select(LINE_COLUMNS).repartition(*keys).sortWithinPartitions(*keys, "section", "key", "seq")
    ordered.select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path)


def write_bundle(named: dict[str, bytes], allowed: set[str], target: str, max_bytes: int = BUNDLE_BYTES) -> str:
    """Zip the allowed report files of one run in name order; returns the digest of the archive."""
    chosen = sorted(n for n in named if n in allowed)
    if sum(len(named[n]) for n in chosen) > max_bytes:
        raise ValueError("bundle exceeds its size limit")
    with zipfile.ZipFile(target + ".part", "w", zipfile.ZIP_DEFLATED) as z:
        for n in chosen:
            z.writestr(n, named[n])
    os.replace(target + ".part", target)
    with open(target, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
