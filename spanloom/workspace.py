"""A workspace: spans and derived tables as generations of Parquet, findings beside them.

Every ingest adds a generation: its new spans, the derived rows of the traces that these belong to, and the list of those
traces. Nothing that is written is changed. Where late spans belong to a trace of an earlier generation, the trace is
derived anew as a whole and its older rows are listed as superseded; readers leave these out. So an ingest writes what it
brings and the late traces, and reads, of what is stored, two id columns. A numbered manifest names the generations: it is
written whole under a new number, and the newest counts, so readers see all of an ingest or nothing. One writer at a time;
a second one fails on the number.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import secrets
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import findings as fs
from spanloom import reports
from spanloom.errors import SpanloomError
from spanloom.functions.scalars import messages_text, since_time
from spanloom.models import describe, replay
from spanloom.models import review as reviews
from spanloom.models.asking import Question
from spanloom.models.budget import Budget, budget_of
from spanloom.operators import causes, detectors, sampling
from spanloom.operators import outputs as output_stage
from spanloom.operators.rates import Found, evidence
from spanloom.plans.derive import attribute, depths, enrich, tables_of
from spanloom.plans.normalize import normalize
from spanloom.schemas import AFFECTED, EMBEDDINGS, FLOW_STEPS, SPAN
from spanloom.sources.registry import name_of, open_source, read_new, step_records
from spanloom.storage import Documents, Storage

AT_ONCE = 6  # jobs
TABLES = ("calls", "steps", "selections", "outputs", "run_calls")
STAGES = ("stats", "outputs", "describe")
LAYOUT = 2  # of the derived tables; those of another are made anew from the spans
CLUSTERS = "id string, workflow string, step string, rank int, size long, total long, center string"
MEMBERS = "span_id string, workflow string, step string, run_id string, start_time timestamp, text string, cluster_id string"
HYPOTHESIS = Question(
    "hypothesis",
    "Given a finding about a workflow's runs, the recorded inputs that set the affected runs apart and samples of what they gave, say in a sentence or two what probably causes it, and nothing that the data doesn't carry.",
    {"hypothesis": {"type": "string"}}
)
NO_CAUSE = "no recorded input sets the affected runs apart"


def at_once(fn: Callable, items: Iterable[tuple]) -> list:
    """``fn(*item)`` of each item, in order. Each starts jobs of its own, and small jobs leave most of a cluster idle."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(fn, *item) for item in items]]


class Ingested(NamedTuple):
    source: str
    added: int


class Report(list):
    """The findings that an analysis shows, ranked; ``notes`` on what was left out or failed; what models cost."""

    def __init__(self, findings: Iterable[fs.Finding], notes: list[str], budget: Budget):
        super().__init__(findings)
        self.notes, self.spent = notes, dataclasses.asdict(budget.spent)
        self.budget_exhausted = any("stopped after" in n for n in notes)


class Scope(Mapping):
    """The scoped tables that a detector reads, by name; ``sql`` runs on views of these names in a session of its own."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], more: Mapping[str, DataFrame]):
        self._spark, self._tables, self._more = spark, tables, more

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def sql(self, query: str, **args) -> DataFrame:
        suffix, text = uuid.uuid4().hex[:8], query
        views = {**self._more, **self._tables}
        session = self._spark.newSession()
        for name, df in views.items():  # a frame belongs to its session; a global view of it is seen by all
            df.createOrReplaceGlobalTempView(f"{name}_{suffix}")
            session.sql(f"CREATE TEMPORARY VIEW {name} AS SELECT * FROM global_temp.{name}_{suffix}")
        return session.sql(text, args=args)


class Workspace:
    def __init__(self, spark: SparkSession, path: str, *, embedder=None, llm=None, replayer=None, step_rerunner=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder, self.llm, self.replayer, self.step_rerunner = embedder, llm, replayer, step_rerunner
        self.docs = Documents(Storage(spark), self.path)
        self.notes: list[str] = []
        self.ingested: list[Ingested] = []

    # --- what is stored

    def _manifest(self) -> dict:
        return self.docs.read("manifest", {"layout": LAYOUT, "generations": [], "superseded": [], "cursors": {}})

    def _parquet(self, paths: Sequence[str], schema: str | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*paths)

    def spans(self) -> DataFrame:
        return self._parquet([g["spans"] for g in self._manifest()["generations"]], SPAN)

    def table(self, name: str, workflow: str | None = None, since=None) -> DataFrame:
        """A derived table, without what was superseded; flow_steps, clusters, members, affected, embeddings too."""
        manifest = self._manifest()
        if manifest["layout"] != LAYOUT:
            manifest = self.rebuild()
        if name in TABLES:
            df = self._derived(manifest, name)
        elif name == "flow_steps":
            df = self._flow_steps(manifest)
        else:
            schema = {"clusters": CLUSTERS, "members": MEMBERS, "affected": AFFECTED, "embeddings": EMBEDDINGS}[name]
            df = self._parquet(manifest.get(name) or [], schema)
        df = df.filter(F.col("workflow") == workflow) if workflow is not None else df
        return df.filter(F.col("start_time") >= F.lit(since)) if since is not None else df

    def _derived(self, manifest: dict, name: str) -> DataFrame:
        generations = manifest["generations"]
        if not generations:
            return tables_of(enrich(self.spans()))[name]
        df = self._parquet([g["tables"][name] for g in generations])
        columns = [c for c in df.columns if c != "_generation"]
        if manifest["superseded"]:
            df = df.join(self.spark.read.parquet(*manifest["superseded"]), ["trace_id", "_generation"], "left_anti")
        return df.select(*columns)

    def _flow_steps(self, manifest: dict) -> DataFrame:
        """The newest records of each run."""
        paths = manifest.get("flow_steps") or []
        if not paths:
            return self.spark.createDataFrame([], FLOW_STEPS)
        df = self.spark.read.parquet(*paths)
        newest = df.groupBy("run_id").agg(F.max("_generation").alias("_generation"))
        return df.join(newest, ["run_id", "_generation"], "left_semi").drop("_generation")

    # --- ingest

    def ingest(self, *sources, since=None) -> int:
        """Add what is new in the sources (the first copy of a span id wins for ever); the number of new spans.

        A malformed span fails the source's whole ingest, with nothing stored of it. With ``since`` a source is read from
        then on; without, from where the last ingest stopped.
        """
        start = since_time(since) if isinstance(since, str) else since
        total = 0
        for source in sources:
            manifest, name, cursor = self._manifest(), name_of(source), None
            if manifest["layout"] != LAYOUT:
                manifest = self.rebuild()
            if start is None and name is not None:
                latest = dt.datetime.fromisoformat(manifest["latest"]) if manifest.get("latest") else None
                raw, cursor = read_new(self.spark, source, manifest["cursors"].get(name), latest=latest, longest_ms=manifest.get("longest_ms", 0.0))
            else:
                raw = open_source(self.spark, source, since=start)
            records = step_records(self.spark, source, since=start)
            added = self._add(manifest, raw, records)
            if name is not None and cursor is not None and manifest["cursors"].get(name) != cursor:
                manifest["cursors"][name] = cursor
                added = added or 0
                self.docs.write("manifest", manifest)
            elif added or records is not None:
                self.docs.write("manifest", manifest)
            self.ingested.append(Ingested(name or type(source).__name__, added))
            total += added
        return total

    def _add(self, manifest: dict, raw: DataFrame | None, records: DataFrame | None) -> int:
        """Write a generation and name it in the manifest (which the caller writes)."""
        number = manifest.get("next", 1)
        where = lambda kind: f"{self.path}/{kind}/{number:06d}-{uuid.uuid4().hex[:8]}"
        if records is not None:
            records.withColumn("_generation", F.lit(number)).write.parquet(path := where("flow_steps"))
            manifest.setdefault("flow_steps", []).append(path)
            manifest["next"] = number + 1
        if raw is None:
            return 0
        normalize(raw).select(*self.spark.createDataFrame([], SPAN).columns).write.parquet(path := where("spans"))
        generations = manifest["generations"]
        # only ids are shuffled to find copies; whole spans move only where there are some
        rows = self.spark.read.schema(SPAN).parquet(path)
        twice = rows.groupBy("span_id").count().filter("count > 1").select("span_id")
        known = self._parquet([g["spans"] for g in generations], SPAN).select("span_id").join(rows.select("span_id"), "span_id", "left_semi")
        if not twice.isEmpty() or (generations and not known.isEmpty()):
            fresh = rows.join(known, "span_id", "left_anti")
            one = Window.partitionBy("span_id").orderBy("start_time", "trace_id", "name")
            first = fresh.join(twice, "span_id", "left_semi").withColumn("_k", F.row_number().over(one)).filter("_k = 1").drop("_k")
            fresh.join(twice, "span_id", "left_anti").unionByName(first).write.parquet(path := where("spans"))
        new = self.spark.read.schema(SPAN).parquet(path)
        length = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000.0
        seen = new.agg(F.count(F.lit(1)).alias("n"), F.max("start_time").alias("latest"), F.max(length).alias("longest")).first()
        if not seen.n:
            return 0
        new.select("trace_id", F.lit(number).alias("_generation")).distinct().write.parquet(traces := where("traces"))
        touched = new
        if generations:
            older = self.spark.read.parquet(*[g["traces"] for g in generations])
            late = older.join(self.spark.read.parquet(traces).select("trace_id"), "trace_id", "left_semi")
            if not late.isEmpty():
                late.write.parquet(gone := where("superseded"))
                gone_rows = self.spark.read.parquet(gone)
                of = {r[0] for r in gone_rows.select("_generation").distinct().collect()}
                before = self._parquet([g["spans"] for g in generations if g["id"] in of], SPAN)
                touched = new.unionByName(before.join(gone_rows.select("trace_id").distinct(), "trace_id", "left_semi"))
                manifest["superseded"].append(gone)
        rows = enrich(touched)

        def write(name: str, df: DataFrame) -> tuple[str, str]:
            df.withColumn("_generation", F.lit(number)).write.parquet(out := where(name))
            return name, out

        tables = dict(at_once(write, tables_of(rows).items()))
        generations.append({"id": number, "spans": path, "traces": traces, "tables": tables})
        manifest["next"] = number + 1
        manifest["latest"] = max(filter(None, [manifest.get("latest"), seen.latest.astimezone(dt.UTC).isoformat()]))
        manifest["longest_ms"] = max(manifest.get("longest_ms", 0.0), float(seen.longest or 0.0))
        return seen.n

    def rebuild(self) -> dict:
        """All generations as one, with every trace derived anew: after many small ingests, or for a new layout."""
        manifest = self._manifest()
        spans = self._parquet([g["spans"] for g in manifest["generations"]], SPAN)
        manifest |= {"layout": LAYOUT, "generations": [], "superseded": []}
        if not spans.isEmpty():
            self._add(manifest, spans, None)
        self.docs.write("manifest", manifest)
        return manifest

    compact = rebuild

    # --- analysis

    def scope(self, workflow: str | None = None, since: dt.datetime | None = None) -> Scope:
        tables = {n: self.table(n, workflow, since) for n in (*TABLES, "flow_steps")}
        return Scope(self.spark, tables, {"spans": self.spans(), "clusters": self.table("clusters")})

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over spans, the derived tables and clusters; arguments are named (:name)."""
        return self.scope().sql(sql, **args)

    def analyze(
        self, workflow: str | None = None, *, since: str | dt.datetime | None = None, stages: Sequence[str] = STAGES,
        budget: Budget | float | str | None = None
    ) -> Report:
        """Detectors over the scoped tables, output analysis, descriptions. What fails becomes a note, the rest goes on."""
        if unknown := set(stages) - set(STAGES):
            raise SpanloomError(f"no stage {', '.join(sorted(unknown))}; there are {', '.join(STAGES)}")
        wallet = budget_of(budget)
        start = since_time(since) if isinstance(since, str) else since
        scoped = self.scope(workflow, start)
        kept = {n: df.cache() for n, df in scoped._tables.items()}
        scope, self.notes = Scope(self.spark, kept, scoped._more), []
        found: list[tuple[fs.Finding, Found | None, dict]] = []
        try:
            # the stages read the same tables and need nothing from each other; alone each leaves most cores idle
            jobs = [(self._stats, scope)] if "stats" in stages else []
            jobs += [(self._outputs, scope)] if "outputs" in stages else []
            found = [x for part in at_once(lambda stage, tables: stage(tables), jobs) for x in part]
            self._save_affected(found)
        finally:
            for df in kept.values():
                df.unpersist()
        if "describe" in stages:
            self._describe(wallet)
        known = self.findings()
        new = [f for f, _, _ in found]
        self._attach(new)
        merged = fs.carry_over(new, known)
        self._save(merged)
        mine = {f.key for f in new}
        return Report([f for f in fs.shown(merged, workflow) if f.key in mine], self.notes, wallet)

    def _stats(self, scope: Scope) -> list:
        found = []
        for part, note in at_once(lambda name, d: self._detect(name, d, scope), detectors.REGISTRY.items()):
            found += part
            self.notes += [note] if note else []
        return found

    def _detect(self, name: str, d: detectors.Registered, scope: Scope) -> tuple[list, str | None]:
        try:
            answer = d.run(scope)
            parts = answer if isinstance(answer, (list, tuple)) else [answer]
            return [x for p in at_once(lambda p: self._read(name, d.category, p), [(p,) for p in parts]) for x in p], None
        except Exception as error:  # noqa: BLE001
            return [], f"{name}: {type(error).__name__}: {str(error).splitlines()[0][:200]}"

    @staticmethod
    def _read(name: str, category: str, part) -> list[tuple[fs.Finding, Found | None, dict]]:
        """Findings of what a detector gave, each with the rows behind it."""
        if isinstance(part, fs.Finding):
            return [(dataclasses.replace(part, detector=part.detector or name, category=part.category or category), None, {})]
        rows = part.rows if isinstance(part, Found) else part
        dicts = [r.asDict(recursive=True) for r in rows.collect()]
        return [(f, part if isinstance(part, Found) else None, r) for f, r in zip(fs.from_rows(name, category, dicts), dicts, strict=True)]

    def _save_affected(self, found: list[tuple[fs.Finding, Found | None, dict]]) -> None:
        """Write the rows behind the findings (finding_key, span_id, run_id, start_time) and put a sample into each. Those of
        known findings that weren't found again stay."""
        if not found:
            return
        by_part: dict[int, tuple[Found, list[tuple]]] = {}
        for f, part, row in found:
            if part is not None:
                by_part.setdefault(id(part), (part, []))[1].append((f.key, f.metric, *[row[k] for k in part.keys]))
        out: list[DataFrame] = []
        for part, rows in by_part.values():
            kinds = ", ".join(f"{k} {part.hits.schema[k].dataType.simpleString()}" for k in part.keys)
            fired = self.spark.createDataFrame(rows, f"finding_key string, metric string, {kinds}")
            on = F.col("h.metric") == F.col("f.metric")
            for k in part.keys:
                on = on & F.col(f"h.{k}").eqNullSafe(F.col(f"f.{k}"))
            hits = part.hits.alias("h").join(F.broadcast(fired.alias("f")), on)
            out.append(
                hits.select(
                    "f.finding_key", F.col("h.span_id").cast("string").alias("span_id"),
                    F.col("h.run_id").cast("string").alias("run_id"), F.col("h.start_time").cast("timestamp").alias("start_time")
                )
            )
        manifest = self._manifest()
        keys = {f.key for f, _, _ in found}

        def write(df: DataFrame) -> str:
            df.write.parquet(path := f"{self.path}/affected/{uuid.uuid4().hex}")
            return path

        paths = at_once(write, [(df,) for df in out])
        if paths:
            sample = evidence(self._parquet(paths, AFFECTED), ["finding_key"]).orderBy("start_time", "span_id").collect()
            listed: dict[str, list[str]] = {}
            for r in sample:
                listed.setdefault(r.finding_key, []).append(r.span_id)
            for f, _, _ in found:
                cluster = [f.details["cluster_id"]] if f.details.get("cluster_id") else []
                f.evidence = f.evidence or [*cluster, *listed.get(f.key, [])]
        if stay := [f.key for f in self.findings() if f.key not in keys]:
            paths += at_once(write, [(self.table("affected").filter(F.col("finding_key").isin(stay)),)])
        manifest["affected"] = paths
        self.docs.write("manifest", manifest)

    def _outputs(self, scope: Scope) -> list:
        """Output analysis; its clusters, members and embeddings are kept."""
        if self.embedder is None:
            self.notes.append("no embedder: outputs were not analyzed")
            return []
        try:
            cache = self.table("embeddings")
            parts, rows, close, vectors = output_stage.analyze_outputs(self.spans(), scope["outputs"], scope["calls"], self.embedder, cache)
            found = [x for p in at_once(lambda p: self._read("outputs", "diversity", p), [(p,) for p in parts]) for x in p]
            shares = close.orderBy(F.col("difference").desc()).collect() if any(f.metric == "largest_cluster_share" for f, _, _ in found) else []
            for f, _, _ in found:
                if f.metric == "largest_cluster_share":
                    mine = [r.asDict() for r in shares if str(r.workflow) == f.scope.get("workflow", "None") and str(r.step) == f.scope.get("step", "None")]
                    f.details["closeness"] = [{k: r[k] for k in ("section", "version", "cluster", "others", "difference")} for r in mine]
                    f.details["notes"] = [] if mine else [output_stage.NO_SECTIONS]
            self._save_clusters(rows, vectors)
            return found
        except Exception as error:  # noqa: BLE001
            self.notes.append(f"outputs: {type(error).__name__}: {str(error).splitlines()[0][:200]}")
            return []

    def _save_clusters(self, rows: DataFrame, vectors: DataFrame) -> None:
        """Clusters of the analyzed steps replace those of the same steps; descriptions go by cluster id."""
        manifest, tag = self._manifest(), uuid.uuid4().hex
        groups = rows.select("workflow", "step").distinct()

        def rest(name: str) -> DataFrame:
            return self.table(name).alias("l").join(
                groups.alias("r"),
                F.col("l.workflow").eqNullSafe(F.col("r.workflow")) & F.col("l.step").eqNullSafe(F.col("r.step")), "left_anti"
            )

        members = rows.select("span_id", "workflow", "step", "run_id", "start_time", "text", "cluster_id")
        fresh = {"clusters": output_stage.cluster_table(rows), "members": members}
        new = vectors.select(F.lit(self.embedder.model_id).alias("model"), "text_sha", "embedding")
        known = self.table("embeddings").filter(F.size("embedding") == self.embedder.dimensions)

        def write(name: str, df: DataFrame) -> tuple[str, str]:
            df.write.parquet(path := f"{self.path}/{name}/{tag}")
            return name, path

        jobs = [(name, df.unionByName(rest(name).select(*df.columns))) for name, df in fresh.items()]
        jobs.append(("embeddings", new.join(known, ["model", "text_sha"], "left_anti")))
        for name, path in at_once(write, jobs):
            manifest[name] = [*manifest.get(name, []), path] if name == "embeddings" else [path]
        self.docs.write("manifest", manifest)

    def _describe(self, wallet: Budget) -> None:
        if self.llm is None:
            return
        said = self.docs.read("descriptions", {})
        known = self.spark.createDataFrame([(k,) for k in said], "cluster_id string")
        new = describe.describe_clusters(self.table("members"), known, self.llm, wallet, self.notes)
        if new:
            self.docs.write("descriptions", said | {c: {"description": d, "in_common": i} for c, d, i in new})

    def _attach(self, found: list[fs.Finding]) -> None:
        """Descriptions of their clusters go to the findings."""
        said = self.docs.read("descriptions", {})
        for f in found:
            if about := said.get(str(f.details.get("cluster_id"))):
                f.details |= about
                f.words = f"{f.title}: {about['in_common']}"

    # --- findings

    def _save(self, findings: list[fs.Finding]) -> None:
        self.docs.write("findings", [dataclasses.asdict(f) for f in findings])

    def findings(self, status: str | None = None) -> list[fs.Finding]:
        all_ = [fs.Finding(**f) for f in self.docs.read("findings", [])]
        return [f for f in all_ if f.status == fs.checked_status(status)] if status else all_

    def finding(self, finding_id: str) -> fs.Finding:
        found = next((f for f in self.findings() if f.id == finding_id), None)
        if found is None:
            raise SpanloomError(f"no finding {finding_id}")
        return found

    def _replace(self, new: fs.Finding) -> fs.Finding:
        self._save([new if f.id == new.id else f for f in self.findings()])
        return new

    def set_status(self, finding_id: str, status: str, note: str = "") -> fs.Finding:
        found = dataclasses.replace(self.finding(finding_id), status=fs.checked_status(status))
        if status == "fixed":
            latest = self.spans().agg(F.max("start_time")).first()[0]
            found.fixed_at = latest.isoformat() if latest else ""
        found.note = note or found.note
        return self._replace(found)

    def affected(self, finding_id: str) -> DataFrame:
        """span_id, run_id, start_time of all rows behind a finding."""
        key = self.finding(finding_id).key
        return self.table("affected").filter(F.col("finding_key") == key).drop("finding_key")

    def report(self, kind: str = "text", workflow: str | None = None, path: str | None = None) -> str:
        if kind not in reports.FORMATS:
            raise SpanloomError(f"no report {kind!r}; there are {', '.join(reports.FORMATS)}")
        shown = fs.shown(self.findings(), workflow)
        more = {"traces": self.traces([s for f in shown for s in f.evidence]), "samples": self._samples(shown)} if kind == "html" else {}
        text = reports.FORMATS[kind](shown, self.notes, **more)
        if path:
            with open(path, "w", encoding="utf-8") as out:
                out.write(text)
        return text

    def traces(self, span_ids: Sequence[str]) -> list[dict]:
        """The spans of the traces that hold some spans (a report's evidence), in order, with their depths."""
        if not span_ids:
            return []
        wanted = self.spark.createDataFrame([(s,) for s in set(span_ids)], "span_id string")
        spans = self.spans()
        ids = spans.join(F.broadcast(wanted), "span_id", "left_semi").select("trace_id").distinct()
        mine = spans.join(F.broadcast(ids), "trace_id", "left_semi")
        took = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000.0
        shown = mine.join(depths(mine), ["trace_id", "span_id"]).select(
            "trace_id", "span_id", "depth", "name", F.col("start_time").cast("string").alias("start_time"),
            F.col("status.code").alias("status"), took.alias("duration_ms")
        )
        return [r.asDict() for r in shown.orderBy("trace_id", "start_time", "span_id").collect()]

    def _samples(self, findings: Sequence[fs.Finding], n: int = 10) -> dict[str, list[str]]:
        ids = [f.details["cluster_id"] for f in findings if f.details.get("cluster_id")]
        if not ids:
            return {}
        rows = evidence(self.table("members").filter(F.col("cluster_id").isin(ids)), ["cluster_id"], n)
        out: dict[str, list[str]] = {}
        for r in rows.orderBy("cluster_id", "start_time", "span_id").select("cluster_id", "text").collect():
            out.setdefault(r.cluster_id, []).append(r.text)
        return out

    # --- causes and tests

    @staticmethod
    def _trace(f: fs.Finding) -> dict[str, str]:
        return {"traceparent": f"00-{secrets.token_hex(16)}-{secrets.token_hex(8)}-01", "finding_id": f.id}

    def explain(self, finding_id: str) -> fs.Finding:
        """Rank the recorded inputs that set a finding's affected runs apart; the best one, if it does, is its cause."""
        f = self.finding(finding_id)
        features = causes.features_by_run(self.table("calls"), self.table("steps"), f.scope)
        top = causes.rank_causes(features, self.affected(finding_id)).limit(causes.TOP).collect()
        listed = [
            {
                "kind": r.kind, "target": r.target, "version": r.version, "effect": r.effect, "ci": [r.low, r.high],
                "runs_with": r.runs_with, "affected_with": r.affected_with
            } for r in top
        ]
        notes = list(f.details.get("notes") or [])
        if features.filter("kind = 'prompt_section'").isEmpty() and output_stage.NO_SECTIONS not in notes:
            notes.append(output_stage.NO_SECTIONS)
        details = f.details | {"causes": listed, "notes": notes}
        if not listed or listed[0]["ci"][0] <= 0:
            notes += [] if NO_CAUSE in notes else [NO_CAUSE]
            return self._replace(dataclasses.replace(f, details=details, cause={"kind": "none", "target": "", "status": "suspected", "hypothesis": NO_CAUSE}))
        best = listed[0]
        cause = {k: best[k] for k in ("kind", "target", "version", "effect", "ci")} | {"status": "suspected", "hypothesis": self._hypothesis(f, listed)}
        return self._replace(dataclasses.replace(f, details=details, cause=cause, fix=proposed_fix(best)))

    def _hypothesis(self, f: fs.Finding, listed: list[dict]) -> str:
        best = listed[0]
        named = f"{best['kind'].replace('_', ' ')} {best['target']}" + (f" v{best['version']}" if best["version"] else "")
        plain = f"{best['affected_with']} of the {best['runs_with']} runs with {named} are affected, a share {best['effect']:.2f} higher than without it."
        if self.llm is None:
            return plain
        texts = self.table("outputs").filter(F.col("span_id").isin(f.evidence[:6])).select(F.substring("text", 1, 400)).limit(5).collect()
        data = {"finding": f.title, "causes": listed, "closeness": (f.details.get("closeness") or [])[:3], "samples": [r[0] for r in texts]}
        answer = HYPOTHESIS.put(self.llm, data, Budget(), self._trace(f))
        return str(answer.values["hypothesis"]) if not answer.error else plain

    def test(
        self, finding_id: str, *, variants: int = 2, samples: int = 20, quality: Callable[[Mapping], float | None] | None = None,
        budget: Budget | float | str | None = None
    ) -> fs.Finding:
        """Make calls with the suspected prompt section again without it; the finding's cause is confirmed, refuted or stays suspected."""
        f = self.finding(finding_id)
        if self.replayer is None:
            raise SpanloomError("a replay test needs a replayer")
        if not f.cause or f.cause["kind"] != "prompt_section":
            raise SpanloomError(f"{finding_id} has no prompt section as its suspected cause; explain it first")
        section = f.cause["target"]
        calls = causes.scoped_calls(self.table("calls"), f.scope).join(
            self.spans().select("span_id", messages_text(attribute("gen_ai.input.messages")).alias("prompt")), "span_id"
        )
        chosen = replay.calls_with(calls, section, samples).select("span_id")
        spans = [r.asDict(recursive=True) for r in self.spans().join(F.broadcast(chosen), "span_id", "left_semi").orderBy("start_time", "span_id").collect()]
        hit = None
        if f.metric == "largest_cluster_share" and self.embedder is not None:
            centre = self.table("clusters").filter(F.col("id") == f.details.get("cluster_id")).join(
                self.table("members"), F.col("center") == F.col("span_id")
            ).select("text").first()
            hit = replay.near_centre(self.embedder, centre.text) if centre else None
        result = replay.replay_test(
            spans, section, replay.section_text(calls, section), f.metric, self.replayer, client=self.llm, hit=hit,
            quality=quality, variants=variants, budget=budget_of(budget), trace=self._trace(f), problem=f.title
        )
        cause = f.cause | {"status": result.status}
        fix = (f.fix or {}) | ({"diff": result.diff, "description": f"{result.best}: {section}", "kind": "prompt_diff"} if result.status == "confirmed" else {})
        return self._replace(dataclasses.replace(f, test=dataclasses.asdict(result), cause=cause, fix=fix))

    # --- review and labels

    def sample(self, workflow: str | None, n: int = 20) -> list:
        """A stratified sample of a workflow's outputs: span_id, text."""
        outputs = self.table("outputs").filter(F.col("workflow").eqNullSafe(workflow))
        mine = [(f.id, s) for f in self.findings() if f.scope.get("workflow") == workflow and f.status != "dismissed" for s in f.evidence]
        seen = self.spark.createDataFrame(mine, "finding_id string, span_id string")
        members = sampling.strata(outputs, self.table("members"), seen, self.table("selections").filter(F.col("workflow").eqNullSafe(workflow)))
        return sampling.stratified(outputs, members, n).select("span_id", "text").collect()

    def taxonomy(self, workflow: str | None) -> reviews.Taxonomy | None:
        known = self.docs.read("taxonomies", {}).get(str(workflow))
        return reviews.Taxonomy(**known) if known else None

    def review(self, workflow: str | None, io: reviews.ReviewIO | None = None, *, n: int = 20, budget: Budget | float | str | None = None) -> reviews.Taxonomy:
        """A taxonomy from the model's notes on a sample, as a person changes it, with the person's labels."""
        if self.llm is None:
            raise SpanloomError("a review needs a text model")
        out = reviews.review(self.sample(workflow, n), str(workflow), self.llm, io or reviews.Console(), budget_of(budget))
        self.docs.write("taxonomies", self.docs.read("taxonomies", {}) | {str(workflow): dataclasses.asdict(out)})
        return out

    def label_all(
        self, workflow: str | None, *, budget: Budget | float | str | None = None,
        confirm: Callable[[int, int], bool] | None = None, force: bool = False
    ) -> reviews.Labelled:
        if self.llm is None:
            raise SpanloomError("labels need a text model")
        taxonomy = self.taxonomy(workflow) or reviews.Taxonomy(str(workflow))
        outputs = self.table("outputs").filter(F.col("workflow").eqNullSafe(workflow)).select("span_id", "text")
        done = reviews.label_all(outputs, taxonomy, self.llm, budget_of(budget), confirm=confirm, force=force)
        self.docs.write("labels", self.docs.read("labels", {}) | {str(workflow): done.labels})
        return done


def proposed_fix(cause: Mapping) -> dict[str, str]:
    kind, target = cause["kind"], cause["target"]
    told = {
        "prompt_section": (
            "prompt_diff",
            f"Take the section {target!r} (version {cause.get('version')}) out of the prompt, or rewrite it; a replay test compares variants"
        ),
        "model": ("model_swap", f"Use another model than {target}"), "param": ("param", f"Change {target}"),
    }
    what, text = told.get(kind, ("prompt_diff", f"Compare {kind.replace('_', ' ')} {target} with the one before"))
    return {"kind": what, "description": text, "diff": ""}
