"""Sources (2.1): source trees, the fact lake, coverage reports, configuration and logs."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.session import cut_lineage
from veinstone.sinks.ledger import Conflict, Ledger, Version

#: 2.1.1: folders that are not walked; fixed values.
EXCLUDED = (".git", ".venv", "venv", "__pycache__", "node_modules", "site-packages", "migrations", "alembic", "dist", "build", ".tox")
MAX_FILES = 100_000


def resolved(spark: SparkSession, root: str) -> str:
    """The root as the paths of :func:`list_tree` begin."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(path).toString().rstrip("/")


def list_tree(spark: SparkSession, root: str, suffix: str = ".py", most: int = MAX_FILES) -> DataFrame:
    """2.1.1, 2.1.6: (path, modificationTime, length) of the files below root, sorted.

    Spark's own file sources skip names that begin with an underscore, such as package
    markers, so the tree is listed through the Hadoop file system: on the driver up to
    ``most`` files, a larger tree level by level on the executors. An excluded name counts
    below the root only.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.resolvePath(base).toString().rstrip("/")
    rows: list[tuple[str, int, int]] = []
    found = fs.listFiles(fs.resolvePath(base), True)
    while found.hasNext():
        f = found.next()
        path = f.getPath().toString()
        parts = path[len(top) :].strip("/").split("/")
        if path.endswith(suffix) and not set(parts[:-1]) & set(EXCLUDED):
            rows.append((path, f.getModificationTime(), f.getLen()))
            if len(rows) > most:
                return list_levels(spark, top, suffix)
    return spark.createDataFrame(sorted(rows), "path string, modificationTime long, length long")


def list_levels(spark: SparkSession, top: str, suffix: str = ".py") -> DataFrame:
    """The rows of :func:`list_tree`, listed by the executors: each round lists the folders that
    the last one found, a share of them to a task, so no list of files or folders is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        uri = top.replace("file:/", "file:///", 1) if top.startswith("file:/") and not top.startswith("file:///") else top
        where, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = where.get_file_info(fs.FileSelector(base.rstrip("/") + folder[len(top) :]))
                kept = [f for f in found if (f.type == fs.FileType.Directory and f.base_name not in EXCLUDED) or (f.type == fs.FileType.File and f.base_name.endswith(suffix))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([top + f.path[len(base.rstrip("/")) :] for f in kept], pa.string()), pa.array([int((f.mtime_ns or 0) // 1_000_000) for f in kept], pa.int64()),
                        pa.array([f.size or 0 for f in kept], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in kept], pa.bool_()),
                    ],
                    names=["path", "modificationTime", "length", "folder"],
                )

    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    folders, files = spark.createDataFrame([(top,)], "path string"), None
    while True:
        found = cut_lineage(folders.repartition(tasks).mapInArrow(run, "path string, modificationTime long, length long, folder boolean"))
        here = found.where("NOT folder").drop("folder")
        files = here if files is None else files.unionByName(here)
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            return files.orderBy("path")


def source_tree(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """The files of :func:`list_tree` with their content."""
    return contents(list_tree(spark, root, suffix))


def contents(files: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """Files with their content; null above ``max_bytes`` or where reading fails. Contents are
    read by the executors, the largest files dealt out first, one to each task in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            contents: list[bytes | None] = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    where, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                    with where.open_input_stream(name) as f:
                        contents.append(f.read() if length <= max_bytes else None)
                except (OSError, pa.ArrowInvalid):
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], names=["path", "modificationTime", "length", "content"])

    tasks = 2 * max(1, files.sparkSession.sparkContext.defaultParallelism)
    dealt = files.coalesce(1).sortWithinPartitions(F.desc("length"), "path").repartition(tasks)
    return dealt.mapInArrow(run, "path string, modificationTime long, length long, content binary")


def cache_split(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """2.1.5, 2.1.8, 2.1.10: files to process, cache rows to reuse, and the pruned cache."""
    key = ["path", "modificationTime", "length"]
    known = cached.select(*key)
    return files.join(known, key, "left_anti"), cached.join(files.select(*key), key, "left_semi"), cached.join(files.select("path"), "path", "left_semi")


#: Parts of a fact lake after which the next addition writes the facts that are still true as one.
LAKE_PARTS = 16


def fact_lake(spark: SparkSession, folder: str, version: str, profile: str) -> Ledger:
    """2.1.7, 2.1.9, 2.2.12: the cached facts of one version and profile, as a versioned table;
    those of others lie elsewhere and are never read."""
    return Ledger(spark, f"{folder.rstrip('/')}/fingerprint_version={version}/profile={profile}")


def add_facts(lake: Ledger, seen: Version, fresh: DataFrame, reuse: DataFrame | None) -> DataFrame:
    """2.1.9: the facts with ``fresh`` ones added to the version ``seen``: these alone are written,
    unless the lake has many parts by now. Facts of changed or deleted files stay in their
    parts until then; nothing joins them. Raises ``Conflict`` if another writer was first."""
    if reuse is None or len(seen.parts) < LAKE_PARTS:
        part = lake.write(fresh)
        rows = lake.part(part) if reuse is None else reuse.unionByName(lake.part(part), allowMissingColumns=True)
        parts = [*seen.parts, part]
    else:
        part = lake.write(reuse.unionByName(fresh, allowMissingColumns=True))
        rows, parts = lake.part(part), [part]
    try:
        lake.commit(seen, parts)
    except Conflict:
        lake.drop(part)
        raise
    return rows


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """2.1.12: (path, line, hits) of a coverage report; repeated lines keep the most hits."""
    schema = "_filename string, lines struct<line: array<struct<_number: int, _hits: int>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    each = rows.select(F.col("_filename").alias("path"), F.explode("lines.line").alias("l"))
    return each.groupBy("path", F.col("l._number").alias("line")).agg(F.max("l._hits").alias("hits"))


def entrypoint_refs(spark: SparkSession, text: str) -> DataFrame:
    """2.1.11: (module, local) of the scripts a project file declares."""
    project = tomllib.loads(text)
    tables = [project.get("project", {}).get(k, {}) for k in ("scripts", "gui-scripts")]
    tables += list(project.get("project", {}).get("entry-points", {}).values())
    tables.append(project.get("tool", {}).get("poetry", {}).get("scripts", {}))
    refs = sorted({tuple(v.split(":", 1)) for t in tables for v in t.values() if isinstance(v, str) and ":" in v})
    return spark.createDataFrame(refs, "module string, local string")


def churn(log: DataFrame, since: str, least: int = 10) -> DataFrame:
    """2.1.14: changes of .py paths in a log (path, at) since a day, often changed ones only."""
    rows = log.where((F.col("at") >= F.lit(since).cast("timestamp")) & F.col("path").endswith(".py"))
    return rows.groupBy("path").agg(F.count("*").alias("changes")).where(F.col("changes") >= least).orderBy(F.desc("changes"), "path")


def changed_paths(spark: SparkSession, diff: str) -> DataFrame:
    """2.1.13: distinct paths of a name-only diff."""
    paths = sorted({p.strip().replace("\\", "/").removeprefix("./") for p in diff.splitlines() if p.strip()})
    return spark.createDataFrame([(p,) for p in paths], "path string")


def document_links(docs: DataFrame, text: str) -> DataFrame:
    """2.1.15: paths in backticks with the heading they stand under."""
    lines = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(text, "\n")).alias("at", "line"))
    heading = F.last(F.when(F.col("line").rlike("^#{1,6} "), F.regexp_replace("line", "^#+ +", "")), True)
    from pyspark.sql import Window

    w = Window.partitionBy(*[c for c in docs.columns if c != text]).orderBy("at")
    rows = lines.withColumn("heading", heading.over(w))
    return rows.select("*", F.explode(F.regexp_extract_all("line", F.lit(r"`([A-Za-z0-9_./-]+/[A-Za-z0-9_.-]+)`"), F.lit(1))).alias("path")).drop("line", "at").distinct()


def count_contradictions(docs: DataFrame, text: str, actual: int, noun: str = "tools?") -> DataFrame:
    """2.1.20: counts that texts claim and that differ from the actual one."""
    found = F.regexp_extract_all(text, F.lit(rf"([0-9]+) (?:[A-Z]+ )?{noun}\b"), F.lit(1))
    return docs.select(F.explode(found).alias("claimed")).select(F.col("claimed").cast("int")).distinct().where(F.col("claimed") != actual)


def module_roles(modules: DataFrame) -> DataFrame:
    """2.1.16."""
    return modules.select("module").distinct().select(F.lit("module_role").alias("type"), F.col("module").alias("subject"))


def risk_notes(hotspots: DataFrame, surfaces: DataFrame) -> DataFrame:
    """2.1.18."""
    return hotspots.select(F.lit("complexity").alias("reason"), F.col("path").alias("subject")).unionByName(surfaces.select(F.lit("security").alias("reason"), F.col("path").alias("subject")))


def test_anchors(names: DataFrame, k: int = 5) -> DataFrame:
    """2.1.19: the first k names over three letters of each test file (path, name)."""
    return names.where(F.length("name") > 3).groupBy("path").agg(F.slice(F.array_sort(F.collect_set("name")), 1, k).alias("names"))


def merge_batches(*batches: DataFrame) -> DataFrame:
    """2.1.21."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out
