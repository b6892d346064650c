"""Source trees written out from table rows, one file per row, for the operators that read source text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread
from .warehouse import table


def _filled(template: str, *values) -> "F.Column":
    """What ``format_string`` gives for ``%d`` and ``%s``, without its formatter, which takes most of the time of making a file."""
    texts = re.split("%[ds]", template)
    held = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null")) for v in values]
    return F.concat(*[x for pair in zip(map(F.lit, texts), [*held, None]) for x in pair if x is not None])


def _lines(*parts) -> "F.Column":
    return F.concat_ws("\n", *[_filled(*p) if isinstance(p, tuple) else F.lit(p) for p in parts])


def order_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> one Python service file each (imports, class, methods, route, config access)."""
    o = spread(table(spark, sf_dir, "orders"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    doc = F.when(F.col("o_orderstatus") == "F", _filled('    """Order of priority %s."""', "o_orderpriority")).otherwise(F.lit("    limit = 10"))
    text = F.concat_ws(
        "\n",
        _lines("import os", ("from lib.util_%d import helper", c % 50), "import json", "",
               ('router = APIRouter(prefix="/api%d")', c % 10), "", ("class Order%d(Base%d):", k, c % 7)),
        doc,
        _lines("", "    def load(self, key):", ("        return fetch_%d(key)", k), "", "    def save(self, value):",
               ("        if value > %d:", c), '            raise ValueError("too big")', "        self.total = value",
               "        session.commit()", "", ('@router.get("/items%d/{key}")', k % 100), ("def fetch_%d(key):", k),
               ('    return os.getenv("KEY_%d") or helper(key)', c % 30), ""),
    )
    return o.select(
        F.concat(F.lit("org"), (c % 3).cast("string")).alias("organization_id"), F.lit("repo:orders").alias("repository_id"),
        _filled("svc%d/mod_%d.py", c % 20, k).alias("path"), text.alias("text"), k.alias("o_orderkey"), c.alias("o_custkey"),
    )


def shared_utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> the library files some of the services import (util_40 and up do not exist)."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("o"), (F.col("c_custkey") % 40).alias("u")).distinct()
    return c.select(
        F.concat(F.lit("org"), F.col("o").cast("string")).alias("organization_id"), F.lit("repo:orders").alias("repository_id"),
        F.format_string("src/lib/util_%d.py", "u").alias("path"), F.lit("def helper(key):\n    return key\n").alias("text"))


def service_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["organization_id", "repository_id", "path", "text"]
    return order_services(spark, sf_dir).select(cols).unionByName(shared_utilities(spark, sf_dir).select(cols))


def part_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> one TypeScript file each that imports its neighbour and a package."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    text = _lines(
        "import React from 'react';", ("import { view%d } from '../%s/part_%d';", k + 1, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), k + 1),
        "const fs = require('fs');", ("export interface Props%d {", k), "  size: number;", "  label?: string;", "}",
        ("export class Part%d extends Base%d {", k, k % 9), "  render() {", ("    return view%d(this);", k), "  }", "}",
        ("export const view%d = (props) => {", k), "  return process.env.API_HOST;", "};", "")
    return p.select(
        F.col("p_type").alias("organization_id"), F.lit("repo:parts").alias("repository_id"),
        F.format_string("%s/part_%d.ts", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), k).alias("path"), text.alias("text"), k.alias("p_partkey"))


def supplier_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> one dependency manifest each, in either ecosystem."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    req = _lines("# pinned", ("pkg-%d>=1.%d", k % 17, k % 5), "-r base.txt", "  requests", "")
    pkg = F.format_string('{"dependencies": {"lib-%d": "^%d.0.0"}, "devDependencies": {"jest": "29"}}', k % 13, k % 4)
    py = (k % 2) == 0
    return s.select(
        F.concat(F.lit("org"), (k % 3).cast("string")).alias("organization_id"), F.lit("repo:suppliers").alias("repository_id"),
        F.concat(F.lit("team"), (k % 25).cast("string"), F.lit("/s"), k.cast("string"), F.when(py, "/requirements.txt").otherwise("/package.json")).alias("path"),
        F.when(py, req).otherwise(pkg).alias("text"),
        F.concat(F.lit("repo:suppliers:module:team"), (k % 25).cast("string")).alias("module_id"), k.alias("s_suppkey"))


def turn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> one Markdown document per turn: title, intro, a section and a short note."""
    t = spread(table(spark, sf_dir, "conversations"))
    text = F.concat(
        F.format_string("# Conversation %d\n\nKept as it was written down by the %s.\n\n## Turn %d\n\n", "conv_id", "role", "turn"),
        "text", F.lit("\n\n```\n# not a heading\n```\n\n### Note\n\nshort\n"))
    return t.select(
        F.concat(F.lit("conv:"), (F.col("conv_id") % 4).cast("string")).alias("organization_id"),
        F.format_string("doc:%d/%d", "conv_id", "turn").alias("doc_id"), F.format_string("turn_%d_%d.md", "conv_id", "turn").alias("filename"),
        text.alias("text"), "conv_id", "turn", F.col("text").alias("turn_text"), "role")


def customer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> one Java entity with a web mapping each."""
    c = spread(table(spark, sf_dir, "customer"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = _lines(
        ("package com.acme.n%d;", n), "", "import java.util.List;", "", "@Entity", ('@RequestMapping("/n%d")', n),
        ("public class Customer%d extends Base%d {", k, k % 5), "    private String name;", "    private long balance = 0;", "",
        '    @GetMapping("/{id}")', "    public String find(long id) {", '        return "${customer.region}";', "    }", "",
        "    public static void main(String[] args) { }", "}", "")
    return c.select(
        F.concat(F.lit("org"), (k % 3).cast("string")).alias("organization_id"), F.lit("repo:customers").alias("repository_id"),
        F.format_string("src/main/java/com/acme/n%d/Customer%d.java", n, k).alias("path"), text.alias("text"), "c_custkey", "c_nationkey")


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> build and deployment files: pyproject, pom, gradle, package.json, Dockerfile, compose, Procfile by key."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    forms = [
        ("pyproject.toml", F.format_string('[project]\nname = "x"\ndependencies = ["dep-%d>=2.%d"]\n', k % 11, k % 4)),
        ("pom.xml", F.format_string("<project><dependencies><dependency><groupId>g%d</groupId><artifactId>a%d</artifactId><version>1.%d</version></dependency></dependencies></project>", k % 5, k % 7, k % 3)),
        ("build.gradle", F.format_string("dependencies {\n    implementation('org.x:y%d:1')\n}\n", k % 9)),
        ("package.json", F.format_string('{"peerDependencies": {"peer-%d": "1"}, "scripts": {"start": "node s%d.js", "lint": "x"}}', k % 6, k)),
        ("Dockerfile", F.format_string("FROM x\nENTRYPOINT [\"run\", \"%d\"]\ncmd serve\n", k)),
        ("docker-compose.yml", F.format_string("services:\n  a:\n    command: start %d\n", k)),
        ("Procfile", F.format_string("web: gunicorn app%d\n", k)),
    ]
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (n, t) in enumerate(forms):
        name, text = F.when(k % 7 == i, n).otherwise(name), F.when(k % 7 == i, t).otherwise(text)
    return s.select(
        F.concat(F.lit("org"), (k % 3).cast("string")).alias("organization_id"), F.lit("repo:builds").alias("repository_id"),
        F.concat_ws("/", F.format_string("b%d", k), name).alias("path"), text.alias("text"), k.alias("s_suppkey"))
