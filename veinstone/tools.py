"""The tool surface over stored runs (2.14): each tool returns a DataFrame or a run id.

A run is a folder of Parquet tables. What one process has analysed, another one can ask
about, and two runs can be compared; nothing is kept on the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.engine import analyze
from veinstone.functions.scalars import below
from veinstone.operators import claims, context, gates, graph, joins, ranking, records, reporting
from veinstone.operators import events as E
from veinstone.operators.windows import numbered
from veinstone.sinks.ledger import Ledger

#: Tables of a run: how each is made from an analysis.
TABLES = {
    "units": lambda a: a.units, "classes": lambda a: a.classes(), "dead_code": lambda a: a.dead_code(True), "edges": lambda a: a.edges(), "cycles": lambda a: a.cycles(),
    "clones": lambda a: a.function_clones(), "clone_members": lambda a: a.clone_members(), "locations": lambda a: a.finding_locations(), "findings": lambda a: a.findings(), "inventory": lambda a: a.inventory(), "adoption": lambda a: a.adoption(),
    "surfaces": lambda a: a.table("surfaces"), "reach": lambda a: a.table("reach"), "calls": lambda a: a.table("calls"), "api": lambda a: a.table("api"), "state": lambda a: a.state(),
}
#: 2.14.5: what to do about each family.
REMEDIES = {
    "complexity": "split the function", "coupling": "depend on fewer modules", "cohesion": "split the class", "dead_code": "remove the symbol or name it in an entry point", "cycle": "invert one import",
    "clone": "move the common body to one function",
}


MEMORY = "id string, type string, subject string, statement string, status string, revision int, updated timestamp"
INTENTS = "intent string, run string, agent string, path string, state string, at timestamp"


class Tools:
    """Runs, records and intents below one folder that all executors share. Records and intents
    are versioned tables: what a caller decides by is what it commits upon."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._memory, self._log = Ledger(spark, f"{self.folder}/memory"), Ledger(spark, f"{self.folder}/intents")

    # runs

    def analyze_repository(self, root: str, **options) -> str:
        """2.14.2: analyse a tree and keep the run; its id."""
        run, name = analyze(self.spark, root, **options), uuid.uuid4().hex[:16]
        for table, make in TABLES.items():
            df = make(run)
            df = df.withColumn("path", below(F.col("path"), run.top)) if "path" in df.columns else df
            df.write.parquet(f"{self.folder}/runs/{name}/{table}")
        stamp = self.spark.range(1).select(F.lit(name).alias("run_id"), F.lit(root).alias("root"), F.current_timestamp().alias("ts"))
        stamp.write.mode("append").parquet(f"{self.folder}/index")
        run.facts.unpersist()
        return name

    def analyze_changed_paths(self, root: str, paths: list[str], **options) -> tuple[str, DataFrame]:
        """2.14.3: a run, and its findings under some paths."""
        run = self.analyze_repository(root, **options)
        return run, self.changed_findings(run, paths)

    def changed_findings(self, run: str, paths: list[str]) -> DataFrame:
        """Findings of all families with a place under one of the paths."""
        wanted = self.spark.createDataFrame([(p.strip("/"),) for p in paths], "p string")
        here = joins.under_paths(self.table(run, "locations"), "path", wanted, "p").select("family", "subject").distinct()
        return self.list_findings(run).join(here, ["family", "subject"], "left_semi")

    def locations(self, run: str, ident: str) -> DataFrame:
        """2.14.5: all places of one finding, in order."""
        return self.table(run, "locations").where(F.concat_ws(":", "family", "subject") == ident).orderBy("path", "start", "qualname")

    def latest_run(self, prefix: str = "") -> str | None:
        """2.9.23, 2.11.12: the newest run by (ts, id), of those that a stored id names."""
        rows = self.spark.read.parquet(f"{self.folder}/index")
        rows = rows.where(records.run_matches(F.col("run_id"), F.lit(prefix))) if prefix else rows
        return rows.agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("r")).collect()[0].r

    def table(self, run: str, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"no table {name!r}; there are {', '.join(sorted(TABLES))}")
        return self.spark.read.parquet(f"{self.folder}/runs/{run}/{name}")

    # blast radius

    def blast_radius(self, run: str, modules: list[str]) -> DataFrame:
        """2.14.4: dependents and level of each module, and the cycle it is in."""
        origins = self.spark.createDataFrame([(m,) for m in modules], "origin string")
        far = graph.transitive_dependents(self.table(run, "edges"), origins).groupBy("origin").agg(F.count("*").alias("transitive"), F.count_if(F.col("depth") == 1).alias("direct"))
        rows = origins.join(far, "origin", "left").fillna(0, ["transitive", "direct"]).withColumn("level", graph.radius_level(F.col("direct")))
        return rows.join(context.cycle_membership(self.table(run, "cycles"), origins), "origin", "left")

    def blast_artifact(self, run: str, module: str) -> DataFrame:
        """2.14.4: every dependent of a module with its distance."""
        return graph.transitive_dependents(self.table(run, "edges"), self.spark.createDataFrame([(module,)], "origin string"))

    # findings

    def list_findings(self, run: str, family: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        """2.14.5: findings with an id, their first place and the number of places, by family, value and subject; a page."""
        f = self.table(run, "findings").withColumn("id", F.concat_ws(":", "family", "subject"))
        first = F.min(F.struct("path", "start", "end"))
        where = self.table(run, "locations").groupBy("family", "subject").agg(first.alias("at"), F.count("*").alias("places"))
        rows = f.join(where, ["family", "subject"], "left").select(*f.columns, "at.path", "at.start", "at.end", "places")
        rows = rows.where(F.col("family") == family) if family else rows
        rows = rows.orderBy("family", F.desc("value"), "subject").offset(offset)
        return rows.limit(limit) if limit is not None else rows

    def finding(self, run: str, ident: str) -> DataFrame:
        return self.list_findings(run).where(F.col("id") == ident)

    def remediation(self, run: str, ident: str) -> DataFrame:
        """2.14.5: severity, effort and what to do."""
        s = ranking.suggestions(self.finding(run, ident).select("family", "subject", "value", "confidence"))
        advice = F.element_at(F.create_map(*[F.lit(x) for kv in REMEDIES.items() for x in kv]), F.regexp_replace("kind", "_suggestion$", ""))
        return s.withColumn("advice", advice)

    def hotspots(self, run: str, k: int = 10) -> DataFrame:
        """2.14.5: the first suggestions of a run."""
        return ranking.suggestions(self.table(run, "findings")).where(F.col("rank") <= k)

    def compare_runs(self, before: str, after: str) -> DataFrame:
        """2.14.5, 2.8.12: findings that were added, removed or stay."""
        ids = [self.table(r, "findings").select(F.concat_ws(":", "family", "subject").alias("id")) for r in (before, after)]
        return joins.set_diff(*ids, "id")

    # checks

    def check(self, run: str, what: str, limit: int | None = None) -> DataFrame:
        """2.14.6: what breaks one limit: complexity, clones, coupling, cohesion or dead_code."""
        tables = {
            "complexity": ("units", F.col("cc") > (20 if limit is None else limit)), "coupling": ("classes", F.col("cbo") > (10 if limit is None else limit)),
            "cohesion": ("classes", F.col("lcom4") > (3 if limit is None else limit)), "clones": ("clones", F.col("items") > (1 if limit is None else limit)),
            "dead_code": ("dead_code", ~F.col("suppressed") & (F.col("confidence") == "high")),
        }
        if what not in tables:
            raise ValueError(f"no check {what!r}; there are {', '.join(sorted(tables))}")
        table, where = tables[what]
        return self.table(run, table).where(where)

    # gates and reports

    def evaluate_gates(self, run: str, config: dict) -> DataFrame:
        """2.14.7."""
        return gates.evaluate(self.table(run, "state"), config)

    def report_section(self, run: str, section: str, limit: int = 50) -> DataFrame:
        """2.14.7: one table of a run."""
        return context.dispatch({name: (lambda n=name: self.table(run, n)) for name in TABLES}, section, limit)

    def pr_summary(self, run: str, before: str, paths: list[str]) -> DataFrame:
        """2.14.7: one row: changed findings, and what the run adds and removes."""
        diff = self.compare_runs(before, run).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
        return self.changed_findings(run, paths).agg(F.count("*").alias("in_changed_paths")).join(F.broadcast(diff))

    # memory

    def _records(self) -> DataFrame:
        """The newest revision of each record."""
        return self._newest(self._memory.table(self._memory.read(), MEMORY))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(F.col("id").alias("_i")).agg(F.max("revision").alias("_r"))
        return rows.join(last, (F.col("id") == F.col("_i")) & (F.col("revision") == F.col("_r"))).drop("_i", "_r")

    def remember(self, rows: DataFrame) -> None:
        """2.14.8: drafts (id, type, subject, statement)."""
        new = rows.select("id", "type", "subject", "statement", F.lit("draft").alias("status"), F.lit(0).alias("revision"), F.current_timestamp().alias("updated"))
        self._memory.change(MEMORY, lambda _: new)

    def decide(self, decisions: DataFrame) -> None:
        """2.14.8, 2.13.18: approve or reject drafts (id, decision); a revision for each. What another
        caller has decided meanwhile is no draft any more and is passed over."""
        status = F.when(F.col("decision") == "approve", "active").otherwise("rejected")

        def decided(rows: DataFrame) -> DataFrame:
            old = self._newest(rows).where("status = 'draft'")
            return old.join(decisions.select("id", "decision"), "id").select("id", "type", "subject", "statement", status.alias("status"), (F.col("revision") + 1).alias("revision"), F.current_timestamp().alias("updated"))

        self._memory.change(MEMORY, decided)

    def memory(self, mode: str, wanted: str = "", limit: int = 20, run: str | None = None) -> DataFrame:
        """2.14.8, 2.14.13: status, get (an id), stale, coverage (paths, comma-joined; without
        any, all of the run's), search, for_path, for_symbol (a qualified name and what it holds),
        drafts or all. ``run``: the run by whose places a record is stale or a path is covered,
        the newest one if none is named."""
        r = self._records()
        modes = {
            "status": lambda: r.groupBy("type", "status").agg(F.count("*").alias("n")), "drafts": lambda: r.where("status = 'draft'").orderBy("id"), "all": lambda: r.orderBy("id"),
            "get": lambda: r.where(F.col("id") == wanted), "stale": lambda: records.without_place(r.where("status = 'active'"), *self._places(run)).orderBy("id"),
            "coverage": lambda: records.subject_coverage(r.where("status IN ('active', 'historical', 'stale')"), self._places(run)[0], [p.strip() for p in wanted.split(",") if p.strip()]),
            "search": lambda: r.join(records.like_matches(r, "id", F.concat_ws(" ", "statement", "subject"), wanted), "id", "left_semi").orderBy("id"),
            "for_path": lambda: joins.under_paths(r, "subject", self.spark.createDataFrame([(wanted,)], "p string"), "p").orderBy("id"),
            "for_symbol": lambda: r.where((F.col("subject") == wanted) | F.col("subject").startswith(f"{wanted}.") | F.col("subject").startswith(f"{wanted}:")).orderBy("id"),
        }
        return context.dispatch(modes, mode, limit)

    def _places(self, run: str | None) -> tuple[DataFrame, DataFrame]:
        """Paths and qualified names of a run, one each."""
        units = self.table(run or self.latest_run(), "units")
        return units.select("path").distinct(), units.select("qualname").distinct()

    def trajectory(self, events: DataFrame, mode: str, wanted: str = "", limit: int = 20) -> DataFrame:
        """2.14.13: the trajectory modes over audit events (those of ``events.trajectories``):
        status, get (a workflow), search (words of its types, outcome and labels) and anomalies."""
        t = E.trajectories(events)
        said = F.concat_ws(" ", "workflow_id", "outcome", "tier", F.array_join("types", " "), F.array_join("labels", " "))
        modes = {
            "status": lambda: t.groupBy("outcome", "tier").agg(F.count("*").alias("n"), F.sum("event_count").alias("events"), F.sum("incidents").alias("incidents")).orderBy("outcome", "tier"),
            "get": lambda: t.where(F.col("workflow_id") == wanted),
            "search": lambda: t.join(records.like_matches(t, "workflow_id", said, wanted), "workflow_id", "left_semi").orderBy(F.desc("last_seq"), "workflow_id"),
            "anomalies": lambda: t.select("workflow_id", F.explode(E.anomalies(t)).alias("a")).groupBy("a.kind", "a.severity").agg(F.count("*").alias("n"), F.min("workflow_id").alias("first")).orderBy("kind"),
        }
        return context.dispatch(modes, mode, limit)

    # observability

    def observability(self, operations: DataFrame, section: str, limit: int = 20) -> DataFrame:
        """2.14.9, 2.14.12: operations (id, parent, correlation, session, started, name, duration, bytes)."""
        from veinstone.operators import metrics

        sections = {
            "recent": lambda: records.select_operations(operations, last=limit), "slowest": lambda: metrics.extremes(operations, limit).where("list = 'slowest'"), "largest": lambda: metrics.extremes(operations, limit).where("list = 'largest'"),
            "tools": lambda: metrics.tool_aggregates(operations, "name", "duration"), "shares": lambda: metrics.shares(operations, "name", "duration"), "sessions": lambda: operations.groupBy("session").agg(F.count("*").alias("n")),
            "payloads": lambda: metrics.payload_footprint(operations, "name", "bytes"), "tree": lambda: graph.forest(operations.select("id", "parent", F.col("started").alias("at"))),
            "roots": lambda: operations.where("parent IS NULL").orderBy(F.desc("started"), "id"), "orphans": lambda: operations.join(operations.select(F.col("id").alias("_i")), F.col("parent") == F.col("_i"), "left_anti").where("parent IS NOT NULL"),
        }
        return context.dispatch(sections, section, limit)

    # controlled change

    def start_change(self, run: str, paths: list[str], agent: str) -> str:
        """2.14.10: declare an intent over some paths; blocked if another one is open on them."""
        rows = self.spark.createDataFrame([(p.strip("/"),) for p in paths], "path string")
        name = uuid.uuid4().hex[:12]

        def opened(log: DataFrame) -> DataFrame:
            if not joins.under_paths(self._states(log).where("state = 'open'"), "path", rows.withColumnRenamed("path", "p"), "p").isEmpty():
                raise ValueError("another open intent covers some of the paths")
            return self._stamped(rows.select(F.lit(name).alias("intent"), F.lit(run).alias("run"), F.lit(agent).alias("agent"), "path", F.lit("open").alias("state")))

        self._log.change(INTENTS, opened)
        return name

    @staticmethod
    def _stamped(rows: DataFrame) -> DataFrame:
        return rows.withColumn("at", F.current_timestamp())

    @staticmethod
    def _states(log: DataFrame) -> DataFrame:
        return log.groupBy("intent", "path").agg(F.max_by(F.struct("run", "agent", "state"), "at").alias("x")).select("intent", "x.run", "x.agent", "path", "x.state")

    def intents(self) -> DataFrame:
        """(intent, run, agent, path, state): the last state of every path of every intent."""
        return self._states(self._log.table(self._log.read(), INTENTS))

    def check_patch(self, intent: str, after: str, changed: list[str], strictness: str = "strict") -> DataFrame:
        """2.14.10, 2.10.4: one row: changed paths out of scope, growth against the run of the intent
        and the budgets that it breaks."""
        own = self.intents().where(F.col("intent") == intent)
        run = own.select("run").first()
        if run is None:
            raise ValueError(f"no intent {intent}")
        paths = self.spark.createDataFrame([(p.strip("/"),) for p in changed], "path string")
        outside = paths.join(joins.under_paths(paths, "path", own.select(F.col("path").alias("p")), "p"), "path", "left_anti")
        a, b = (self.table(r, "state").select(F.struct("*").alias(n)) for r, n in ((run.run, "a"), (after, "b")))
        grown = {"new_clones": "clone_total", "new_cycles": "dependency_cycles", "complexity_growth": "complexity_max"}
        rows = a.join(b).select(*[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(n) for n, c in grown.items()]).withColumn("broken", gates.over_budget(strictness))
        return rows.join(outside.agg(F.count("*").alias("out_of_scope")))

    def finish_change(self, intent: str, after: str, changed: list[str], strictness: str = "strict") -> DataFrame:
        """2.14.10: the receipt of a change; the intent is closed as accepted or violated."""
        receipt = self.check_patch(intent, after, changed, strictness).withColumn("accepted", (F.size("broken") == 0) & (F.col("out_of_scope") == 0))
        row = receipt.collect()[0]
        rows = self.intents().where(F.col("intent") == intent).select("intent", F.lit(after).alias("run"), "agent", "path", F.lit("accepted" if row.accepted else "violated").alias("state"))
        self._log.change(INTENTS, lambda _: self._stamped(rows))
        return receipt

    def validate_claims(self, run: str, texts: DataFrame, before: str | None = None) -> dict[str, DataFrame]:
        """2.14.10, 2.10.11: citations, violations and warnings of texts (text_id, text)."""
        f = self.table(run, "findings").withColumn("id", F.concat_ws(":", "family", "subject"))
        reach = self.table(run, "reach").select(F.col("qualname").alias("_q")).distinct()
        f = f.join(reach, F.col("subject") == F.col("_q"), "left").withColumn("reachable", F.col("_q").isNotNull()).withColumn("report_only", F.col("family").isin("clone"))
        known = self.table(before, "findings").select(F.concat_ws(":", "family", "subject").alias("_k")).distinct() if before else self.spark.createDataFrame([], "_k string")
        f = f.join(known, F.col("id") == F.col("_k"), "left").withColumn("novelty", F.when(F.col("_k").isNotNull(), "known").otherwise("new"))
        cited = claims.citations(texts, f)
        return {"citations": cited, "violations": claims.violations(cited, f, before is not None), "text_violations": claims.text_violations(texts, before is not None, None), "warnings": claims.warnings(texts, cited)}

    # sessions

    def session_stats(self) -> DataFrame:
        """2.14.11: intents by agent and state, and the runs they are about."""
        return self.intents().groupBy("agent", "state").agg(F.countDistinct("intent").alias("intents"), F.countDistinct("run").alias("runs"), F.count("*").alias("paths"))

    def audit_trail(self, events: DataFrame, repo: str, workflow: str | None = None) -> DataFrame:
        """2.14.11: the events of a repository in order, numbered."""
        return numbered(records.audit_scan(events, repo, workflow), [F.asc("workflow_id"), F.asc("id")], "place")

    def payload(self, run) -> DataFrame:
        """2.6.23: the families of an analysis as (family, summary as JSON)."""
        parts = [df.select(F.lit(name).alias("family"), F.to_json(F.struct("*")).alias("summary")) for name, df in reporting.payload(run).items()]
        return reduce(DataFrame.unionByName, parts)
