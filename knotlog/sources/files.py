"""Files of a repository as tables: contents, imports, annotations, documents."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.functions import paths
from knotlog.functions.text import annotation, annotation_body, h2_sections, severity_of_name, slugify, title_of
from knotlog.sources.scratch import written

MAX_BYTES = 2 * 1024 * 1024
#: Our own list of paths that hold secrets; such files are not read.
SECRET_PATHS = [".env", ".env.*", "*.pem", "*.key", "*.p12", "id_rsa", "id_ed25519", "credentials", "credentials.*", "*.secret"]
#: Folders from which on tasks list whole subtrees, files that a task reads, and bytes of them at once.
FOLDERS, FILES_A_TASK, BATCH_BYTES = 256, 200, 4 << 20
ANNOTATED = [".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".java"]


def file_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """``path, content, bytes, hash`` of files under a root.

    Hidden folders other than ``.github``, excluded and secret paths, and files
    over a size are left out.  A root with a scheme (``s3://``, ``hdfs://``) is
    listed by Spark, which never sees names that start with ``.`` or ``_``; a
    plain path must be mounted on all executors, and its names are all seen.
    """
    return contents(spark, root, listing(spark, root, exclude, most))


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """``path, bytes, modified`` of the files that ``file_tree`` reads; no content is read."""
    if "://" in root:
        raw = _binary(spark, root)
        rows = raw.select(_relative(root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    else:
        rows = _mounted(spark, root.rstrip("/"))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda p: p.startswith(".") & (p != ".github"))
    return rows.where(~hidden & (F.col("bytes") <= most) & ~paths.excluded(F.col("path"), [*(exclude or []), *SECRET_PATHS]))


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``path, content, bytes, hash`` of listed files (``path``) of a root."""
    if "://" in root:
        raw = _binary(spark, root).select(_relative(root).alias("path"), "content", F.col("length").alias("bytes"))
        rows = raw.join(files.select("path"), "path", "left_semi")
    else:
        top = root.rstrip("/")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, data, size = [], [], 0
                for path in batch.column("path").to_pylist():
                    full = os.path.join(top, path)
                    if os.path.isfile(full):
                        with open(full, "rb") as f:
                            names.append(path)
                            data.append(f.read())
                        size += len(data[-1])
                    if size > BATCH_BYTES:  # contents may be large
                        yield made(names, data)
                        names, data, size = [], [], 0
                if names:
                    yield made(names, data)

        def made(names: list[str], data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary()), pa.array([len(x) for x in data], pa.int64())], ["path", "content", "bytes"])

        listed = written(files.select("path"), "listing")
        tasks = max(1, min(10_000, listed.count() // FILES_A_TASK + 1))
        rows = listed.repartition(tasks).mapInArrow(read, "path string, content binary, bytes long")
    return rows.withColumn("hash", F.sha2("content", 256))


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def _relative(root: str) -> Column:
    top = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), "^.*" + _quoted(top) + "/", "")


def _folders(root: str) -> list[tuple[str, bool]]:
    """Folders to list, and whether with all below them: the tree's top, level by level, until there are enough for tasks."""
    out, level = [], [root]
    while level and len(level) < FOLDERS:
        out += [(f, False) for f in level]
        below = []
        for folder in level:
            with os.scandir(folder) as each:
                below += [e.path for e in each if e.is_dir(follow_symlinks=False) and (not e.name.startswith(".") or e.name == ".github")]
        level = below
    return out + [(f, True) for f in level]


def _mounted(spark: SparkSession, root: str) -> DataFrame:
    """Files of a mounted folder; the driver sees the names of its upper folders only, tasks list what is in them."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top, deep in zip(batch["folder"], batch["deep"], strict=True):
                for folder, below, names in os.walk(top):
                    below[:] = [d for d in below if deep and (not d.startswith(".") or d == ".github")]
                    own = [os.path.join(folder, n) for n in names]
                    own = [(os.path.relpath(x, root), s.st_size, s.st_mtime_ns // 1000) for x in own if os.path.isfile(x) and (s := os.stat(x))]
                    for at in range(0, len(own), 10_000):
                        yield pd.DataFrame(own[at : at + 10_000], columns=["path", "bytes", "micros"])

    folders = _folders(root)
    found = spark.createDataFrame(folders, "folder string, deep boolean").repartition(max(1, min(1000, len(folders) // 4 + 1))).mapInPandas(walk, "path string, bytes long, micros long")
    return found.select("path", "bytes", F.timestamp_micros("micros").alias("modified"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def nodes(files: DataFrame, now: Column) -> DataFrame:
    """Files as rows of the ``nodes`` collection."""
    p = F.col("path")
    return files.select(
        p.alias("id"), F.lit("file").alias("type"), paths.base_name(p).alias("name"), p.alias("file_path"), paths.language(p).alias("language"),
        paths.detect_module(p).alias("module"), paths.classify(p).alias("class"), F.lit(1.0).alias("stability"), F.lit("active").alias("status"),
        F.col("hash").alias("content_hash"), now.alias("created_at"), now.alias("updated_at"),
    )


def _imports(language: Column, text: Column) -> Column:
    """Import paths of a file's text by its language."""
    block = F.regexp_extract_all(text, F.lit(r'(?ms)^import\s*\((.*?)^\)'), F.lit(1))
    go = F.concat(F.flatten(F.transform(block, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), F.lit(1)))), F.regexp_extract_all(text, F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1)))
    py = F.concat(
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^import[ \t]+([^#\n]+)"), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.split_part(F.trim(y), F.lit(" "), F.lit(1)))))),
        F.regexp_extract_all(text, F.lit(r"(?m)^from[ \t]+(\S+)[ \t]+import\b"), F.lit(1)),
    )
    js = F.regexp_extract_all(text, F.lit(r"""(?m)^(?:import|export)\s[^'";]*?from\s*['"]([^'"]+)['"]|^import\s*['"]([^'"]+)['"]"""), F.lit(0))
    js = F.transform(js, lambda x: F.regexp_extract(x, r"""['"]([^'"]+)['"]\s*$""", 1))
    java = F.regexp_extract_all(text, F.lit(r"(?m)^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"), F.lit(1))
    return F.when(language == "Go", go).when(language == "Python", py).when(language.isin("JavaScript", "TypeScript"), js).when(language == "Java", java).otherwise(F.array().cast("array<string>"))


def import_paths(path: Column, content: Column) -> Column:
    """Import paths of a file (Go, Python, JS/TS, Java), each once."""
    return F.filter(F.array_distinct(_imports(paths.language(path), F.decode(content, "UTF-8"))), lambda x: x != "")


def imports(files: DataFrame) -> DataFrame:
    """``path, import_path`` of top-level imports (Go, Python, JS/TS, Java)."""
    return files.select("path", F.explode(import_paths(F.col("path"), F.col("content"))).alias("import_path"))


def import_links(files: DataFrame) -> DataFrame:
    """Imports as links; the target is the import string itself."""
    return links_of(imports(files))


def links_of(imports: DataFrame) -> DataFrame:
    """``path, import_path`` as links."""
    return imports.select(F.concat(F.lit("e:"), "path").alias("src_ref"), F.lit("imports").alias("edge_type"), F.concat(F.lit("e:"), "import_path").alias("dst_ref"))


def go_module(files: DataFrame) -> DataFrame:
    """``path, module_path`` of every go.mod."""
    text = F.decode(F.col("content"), "UTF-8")
    return files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select("path", F.regexp_extract(text, r"(?m)^\s*module\s+(\S+)", 1).alias("module_path")).where("module_path <> ''")


def annotations(files: DataFrame, tag: str = "@kb") -> DataFrame:
    """``file, line, type, name, description`` of annotation comments."""
    code = files.where(paths.extension(F.col("path")).isin(ANNOTATED) & ~F.col("path").rlike(r"(^|/)(vendor|node_modules|\.[^/]*)/"))
    lines = code.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode(F.col("content"), "UTF-8"), "\r?\n")).alias("at", "text"))
    found = lines.withColumn("a", annotation(F.col("text"), tag)).where("a IS NOT NULL")
    return found.select("file", (F.col("at") + 1).alias("line"), "a.type", "a.name", "a.description")


def annotation_decisions(found: DataFrame) -> DataFrame:
    """Rule annotations as decisions, with the file each is anchored to."""
    rules = found.where("type = 'rule'")
    return rules.select(
        F.concat(F.lit("rule:"), "name").alias("id"), F.col("name").alias("title"), annotation_body(F.col("file"), F.col("line"), F.col("description")).alias("body"),
        severity_of_name(F.col("name")).alias("severity"), F.lit("file").alias("scope"), F.lit("annotation").alias("source"), "file",
    )


def adr_decisions(files: DataFrame, folder: str = "docs/adr") -> DataFrame:
    """One must-decision for each Markdown file right under a folder."""
    own = files.where(F.col("path").rlike(rf"^{folder}/[^/]+\.(?i:md)$"))
    text, base = F.decode(F.col("content"), "UTF-8"), F.regexp_replace(paths.base_name(F.col("path")), r"\.[^.]*$", "")
    return own.select(F.concat(F.lit("adr:"), base).alias("id"), title_of(text).alias("title"), text.alias("body"), F.lit("must").alias("severity"), F.lit("global").alias("scope"), F.lit("adr").alias("source"), F.col("path").alias("file")).orderBy("id")


def doc_decisions(files: DataFrame, modules: dict[str, str] | None = None, folder: str = "docs") -> DataFrame:
    """One decision for each ``## `` section of the Markdown files under a folder.

    ``modules`` names the module that a document governs; without one its
    decisions are global.
    """
    own = files.where(F.col("path").rlike(rf"^{folder}/[^/]+\.md$"))
    base = F.regexp_replace(paths.base_name(F.col("path")), r"\.md$", "")
    module = F.element_at(F.create_map(*[F.lit(x) for p in (modules or {"": ""}).items() for x in p]), base)
    rows = own.select("path", base.alias("base"), module.alias("module"), F.explode(h2_sections(F.decode(F.col("content"), "UTF-8"))).alias("s"))
    scope = F.when(F.coalesce("module", F.lit("")) != "", "module").otherwise("global")
    return rows.select(F.concat(F.lit("doc:"), "base", F.lit(":"), slugify(F.col("s.title"))).alias("id"), F.substring("s.title", 1, 200).alias("title"), F.col("s.body").alias("body"), F.lit("should").alias("severity"), scope.alias("scope"), F.lit("doc").alias("source"), F.col("path").alias("file"), "module").orderBy("id")


def toml(text: str) -> dict:
    """Settings, recipes and manifests are TOML, read on the driver."""
    return tomllib.loads(text)


def layered(*layers: dict) -> dict:
    """Settings of several layers; a later one wins, tables are merged."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
