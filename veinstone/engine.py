"""The library entry: analyse a source tree, then ask for findings, metrics and reports
(2.14). Every method returns a lazy DataFrame unless it says otherwise."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions.scalars import below, cohesion_risk, complexity_risk, coupling_risk, is_test_path
from veinstone.operators import clones, context, extract, gates, graph, joins, metrics
from veinstone.operators.windows import merge_intervals
from veinstone.session import cut_lineage
from veinstone.sinks import report
from veinstone.sinks.ledger import Conflict
from veinstone.sources import readers


#: Facts of another version of the extractor are not reused.
FACTS_VERSION = "3"


class Analysis:
    """One run over a source tree. Facts are extracted once and kept for all questions."""

    def __init__(self, spark: SparkSession, root: str, min_loc: int = 10, min_stmt: int = 6, entrypoints: DataFrame | None = None, cache: str | None = None) -> None:
        self.spark, self.root, self.min_loc, self.min_stmt, self.entrypoints, self.cache = spark, root, min_loc, min_stmt, entrypoints, cache

    @cached_property
    def facts(self) -> DataFrame:
        """Facts of every file; with a ``cache`` folder, only new and changed files are read."""
        files = readers.list_tree(self.spark, self.root)
        if not self.cache:
            return extract.extract(readers.contents(files), self.top).persist()
        stamp = files.select("path", "modificationTime", "length")
        lake = readers.fact_lake(self.spark, self.cache, FACTS_VERSION, "full")
        while True:
            seen = lake.read()
            todo, reuse = stamp, None
            if seen.parts:
                todo, reuse, _ = readers.cache_split(stamp, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [lake.part(p) for p in seen.parts]))
                todo = cut_lineage(todo)
                if todo.isEmpty():
                    return reuse.persist()
            fresh = extract.extract(readers.contents(todo), self.top).join(F.broadcast(stamp), "path")
            try:
                return readers.add_facts(lake, seen, fresh, reuse).persist()
            except Conflict:  # another run has added facts meanwhile
                continue

    @cached_property
    def top(self) -> str:
        """The root as the files' paths begin."""
        return readers.resolved(self.spark, self.root)

    def table(self, family: str) -> DataFrame:
        return extract.family(self.facts, family)

    @property
    def units(self) -> DataFrame:
        return self.table("units").withColumn("risk", complexity_risk(F.col("cc")))

    def function_clones(self) -> DataFrame:
        u = self.units.where((F.col("loc") >= self.min_loc) & (F.col("stmt_count") >= self.min_stmt))
        return clones.function_groups(u)

    def block_clones(self, size: int = 4) -> DataFrame:
        return clones.block_groups(extract.statement_windows(self.facts, size, 15, 8))

    def segment_clones(self, size: int = 6) -> DataFrame:
        s = extract.statement_windows(self.facts, size, 60, 10)
        again = clones.segment_groups(s).select("segment_hash", "qualname", "group_key")
        rows = s.join(again, ["segment_hash", "qualname"]).select("group_key", "path", "qualname", "start", "end")
        return merge_intervals(rows, ["group_key", "path", "qualname"], "start", "end")

    def dead_code(self, with_suppressed: bool = False) -> DataFrame:
        """2.8.4, 2.8.5; symbols that only tests use are dead."""
        c = extract.suppressed(self.table("candidates"), self.table("suppressions")).where(~is_test_path(below(F.col("path"), self.top)))
        reach = self.table("reach").select("qualname")
        if self.entrypoints is not None:
            reach = reach.unionByName(joins.entrypoints(self.entrypoints, c.select("qualname")).select("qualname"))
        names, quals = (extract.referenced(self.facts, k) for k in ("names", "qualnames"))
        dead = joins.unreferenced(c, names, quals, reach)
        return dead if with_suppressed else dead.where(~F.col("suppressed"))

    def edges(self) -> DataFrame:
        roots = self.facts.where("ok").select(F.substring_index("module", ".", 1).alias("root")).distinct()
        return graph.internal(graph.edges(self.table("deps"), "source", "target"), roots)

    @cached_property
    def _cycles(self) -> DataFrame:
        return graph.cycles(self.edges()).persist()

    def cycles(self) -> DataFrame:
        return self._cycles

    def blast_radius(self, modules: list[str]) -> DataFrame:
        """2.7.20: direct and transitive dependents of modules, with the level of each."""
        origins = self.spark.createDataFrame([(m,) for m in modules], "origin string")
        e = self.edges()
        far = graph.transitive_dependents(e, origins).groupBy("origin").agg(F.count("*").alias("transitive"), F.count_if(F.col("depth") == 1).alias("direct"))
        rows = origins.join(far, "origin", "left").fillna(0, ["transitive", "direct"])
        return rows.withColumn("level", graph.radius_level(F.col("direct")))

    def callers(self, qualname: str) -> DataFrame:
        """2.7.22: callers and callees of a symbol."""
        c = self.table("calls")
        return c.where(F.col("callee") == qualname).select(F.lit("caller").alias("role"), F.col("caller").alias("symbol"), "path", "line").unionByName(
            c.where(F.col("caller") == qualname).select(F.lit("callee").alias("role"), F.col("callee").alias("symbol"), "path", "line")
        )

    def context(self, qualname: str, budget: int = 40) -> DataFrame:
        """2.7.22: what is around a symbol."""
        return joins.around(qualname, self.table("calls"), self.table("deps"), self.table("api"), budget)

    def classes(self) -> DataFrame:
        return self.table("classes").withColumns({"coupling_risk": coupling_risk(F.col("cbo")), "cohesion_risk": cohesion_risk(F.col("lcom4"))})

    def coverage(self, lines: DataFrame) -> DataFrame:
        u = self.units.select(below(F.col("path"), self.top).alias("path"), "qualname", "start", "end", "risk")
        return joins.coverage_join(u, lines)

    def adoption(self) -> DataFrame:
        """2.6.6."""
        a = self.facts.where("ok").select("adoption.*")
        return a.agg(*[F.sum(c).alias(c) for c in a.columns])

    def inventory(self) -> DataFrame:
        """2.6.25."""
        s = self.facts.select("ok", "error_kind", "stats.*")
        return s.agg(F.count("*").alias("files"), F.count_if("ok").alias("analysed"), F.count("error_kind").alias("failed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "functions", "methods", "classes")])

    def security_surfaces(self) -> DataFrame:
        """2.6.21."""
        return self.table("surfaces").groupBy("category").agg(F.count("*").alias("items"), F.countDistinct("path").alias("modules"))

    def reachability(self) -> DataFrame:
        """2.6.22."""
        return context.counts_by(self.table("reach"), "framework", "edge_kind", "confidence")

    def instance_methods(self) -> DataFrame:
        m = self.table("methods").withColumn("kind", F.col("why"))
        return gates.instance_methods(m)

    def findings(self) -> DataFrame:
        """One table of findings: (family, subject, value, confidence)."""
        a = self.units.where("cc > 20").select(F.lit("complexity").alias("family"), F.col("qualname").alias("subject"), F.col("cc").cast("long").alias("value"), F.lit("high").alias("confidence"))
        b = self.classes().where("cbo > 10").select(F.lit("coupling"), "qualname", F.col("cbo").cast("long"), F.lit("high"))
        c = self.classes().where("lcom4 > 3").select(F.lit("cohesion"), "qualname", F.col("lcom4").cast("long"), F.lit("high"))
        d = self.dead_code().select(F.lit("dead_code"), "qualname", F.lit(1).cast("long"), "confidence")
        e = self.cycles().select(F.lit("cycle"), "component", "size", F.lit("high"))
        f = self.function_clones().select(F.lit("clone"), "group_id", "items", F.lit("high"))
        return a.union(b).union(c).union(d).union(e).union(f)

    def finding_locations(self) -> DataFrame:
        """(family, subject, path, qualname, start, end): where each finding of each family is; a
        clone and a cycle have several places. Paths are relative to the root."""
        place = [F.lit("").alias("family"), F.col("qualname").alias("subject"), "path", "qualname", "start", "end"]
        rows = [self.units.where("cc > 20").select(*place).withColumn("family", F.lit("complexity"))]
        rows += [self.classes().where(where).select(*place).withColumn("family", F.lit(family)) for family, where in (("coupling", "cbo > 10"), ("cohesion", "lcom4 > 3"))]
        rows += [self.dead_code().select(*place).withColumn("family", F.lit("dead_code"))]
        files = self.facts.select(F.col("module").alias("_m"), "path", F.col("stats.lines").cast("int").alias("end"))
        members = self.cycles().select(F.col("component").alias("subject"), F.explode("members").alias("_m"))
        rows += [members.join(files, "_m").select(F.lit("cycle").alias("family"), "subject", "path", F.col("_m").alias("qualname"), F.lit(1).alias("start"), "end")]
        rows += [self.clone_members().select(F.lit("clone").alias("family"), F.col("group_id").alias("subject"), "path", "qualname", "start", "end")]
        return reduce(DataFrame.unionByName, rows).withColumn("path", below(F.col("path"), self.top))

    def state(self) -> DataFrame:
        """2.10.2: the one-row state that gates read."""
        u = self.units.agg(F.coalesce(F.max("cc"), F.lit(0)).alias("complexity_max"))
        c = self.classes().agg(F.coalesce(F.max("cbo"), F.lit(0)).alias("coupling_max"), F.coalesce(F.max("lcom4"), F.lit(0)).alias("cohesion_max"))
        d = self.dead_code().agg(F.count_if(F.col("confidence") == "high").alias("dead_high_confidence"))
        y = self.cycles().agg(F.count("*").alias("dependency_cycles"))
        k = self.function_clones().agg(F.count("*").alias("clone_total"))
        return u.join(c).join(d).join(y).join(k)

    def evaluate_gates(self, config: dict) -> DataFrame:
        return gates.evaluate(self.state(), config)

    def modules(self) -> DataFrame:
        return self.facts.where("ok").select("module")

    def clone_members(self) -> DataFrame:
        """Functions of the clone groups, by group."""
        u = clones.eligible(self.units, self.min_loc, self.min_stmt).withColumn("group_key", F.concat_ws("|", "fingerprint", "loc_bucket"))
        return u.select("group_key", "path", "qualname", "start", "end").join(self.function_clones().select("group_key", "group_id"), "group_key")

    def overloaded(self) -> DataFrame:
        """2.6.12: modules by size and links."""
        size = self.facts.where("ok").select("module", F.col("stats.lines").alias("lines"), (F.col("stats.functions") + F.col("stats.methods")).alias("callables"))
        links = graph.fan(self.edges()).select(F.col("node").alias("module"), "fan_in", "fan_out")
        return metrics.overloaded(size.join(links, "module", "left").fillna(0, ["fan_in", "fan_out"]), "module", ["lines", "callables"], ["fan_in", "fan_out"])

    def summary(self) -> DataFrame:
        return metrics.complexity_summary(self.units)

    def sections(self) -> dict[str, tuple[DataFrame, list[str]]]:
        """The sections of the report and their order."""
        return {"inventory": (self.inventory(), ["files"]), "findings": (self.findings(), ["family", "subject"]), "cycles": (self.cycles(), ["component"])}

    def report(self, changed: list[str] | None = None) -> DataFrame:
        """2.2.1: the canonical document, one row; with ``changed``, only findings that
        have a place under these paths (relative to the root)."""
        found = self.findings()
        if changed:
            wanted = self.spark.createDataFrame([(p.strip("/"),) for p in changed], "p string")
            here = joins.under_paths(self.finding_locations(), "path", wanted, "p").select("family", "subject").distinct()
            found = found.join(here, ["family", "subject"], "left_semi").select(*found.columns)
        parts = self.sections() | {"findings": (found, ["family", "subject"])}
        return report.document(parts, {"root": self.root.rstrip("/").rpartition("/")[2]})


def analyze(spark: SparkSession, root: str, **options) -> Analysis:
    """2.14.2, 2.14.14."""
    return Analysis(spark, root, **options)
