"""One object for all tools: build, update, and every query, as DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema, sinks
from .functions.text import embedding_text
from .lineage import cut
from .operators import areas as area_rules
from .operators import confidence, context, drift, graph, health, intent, linking, notes, onboarding, relink, reports, semantic, vectors, viz
from .sources import config as config_source
from .sources import files as file_source
from .sources import parse
from .store import STORED, TABLES, Store


class Engine:
    def __init__(self, spark: SparkSession, root: str, areas: dict[str, str] | None = None, tracked=file_source.TRACKED, embed=vectors.hashed_embedding, half_life: float = schema.HALF_LIFE, stale: float = 0.1, possibly_stale: float = 0.3):
        """embed: a function of a text column, or the name of one; None searches
        by vectors only. `learned`: each build fits a model to its units, which the
        index holds; updates embed with it."""
        self.learned = embed == "learned"
        own = vectors.embedder(embed) if isinstance(embed, str) and not self.learned else embed
        self.stale, self.possibly_stale = stale, possibly_stale
        self.spark, self.store, self.areas, self.tracked, self.half_life = spark, Store(spark, root), areas or {}, tracked, half_life
        self._embed, self._fitted = own, (None, None)

    @classmethod
    def of_config(cls, spark: SparkSession, root: str, path: str) -> Engine:
        c = config_source.load_config(path)
        return cls(spark, root, c.areas, c.tracked, c.embedding, c.half_life, c.stale, c.possibly_stale)

    @property
    def units(self) -> DataFrame:
        return self.store.read("units")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    @property
    def embed(self):
        """The embedding in use; a learned one is the current snapshot's."""
        if not self.learned:
            return self._embed
        parts = self.store.parts("model")
        if not parts:
            raise ValueError("the index holds no learned model: build it with one")
        if self._fitted[0] != parts:
            self._fitted = (parts, semantic.Model.of_rows(self.store.read("model")))
        return self._fitted[1]

    # ------------------------------------------------------ build and update

    def _embedded(self, units: DataFrame, embed=None) -> DataFrame:
        """id, embedding, file of units."""
        embed = embed or self.embed
        if embed is None:
            return self.spark.createDataFrame([], schema.VECTORS + ", file string")
        return units.select("id", embed(embedding_text("name", "signature", "docstring")).alias("embedding"), "file")

    def _embed_notes(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", self.embed(F.concat_ws(" ", "title", "body")).alias("embedding"))

    def _meta(self, hashes: DataFrame, built: str) -> DataFrame:
        state = drift.state_hash(hashes).select(F.lit("state_hash").alias("key"), F.col("state_hash").alias("value"))
        return self.spark.createDataFrame([("schema_version", str(schema.SCHEMA_VERSION)), ("last_build", built)], schema.META).union(state)

    def build(self, files: DataFrame, built: str, now: int | None = None, commit: str | None = None, documents: str | None = None) -> str:
        """Index files (file, content, hash) anew; built is an ISO time. Then
        notes decay, the metrics join the history and, if a folder is named,
        the areas' documents are written. One engine builds or updates at a time."""
        with self.store.lease() as lease:
            before = self.store.number()
            parsed = cut(parse.parse(files))
            units, captures, hashes = cut(parse.units_of(parsed)), relink.with_names(parse.captures_of(parsed)), cut(files.select("file", "hash"))
            edges = linking.link_named(captures, units)
            model = semantic.fit(units, embedding_text("name", "signature", "docstring")) if self.learned else None
            tables = {"units": units, "captures": captures, "edges": edges, "vectors": self._embedded(units, model), "file_hashes": hashes, "meta": self._meta(hashes, built)}
            if model is not None:
                tables["model"] = model.rows(self.spark)
            name = self.store.publish(tables, files=hashes.count(), based_on=before, lease=lease)
            if model is not None and not self.store.read("notes").isEmpty():
                # Vectors of two models don't compare.
                self.store.replace("note_vectors", self._embed_notes(self.store.read("notes")))
            self._after(None, now, commit, documents)
        return name

    def changes(self, files: DataFrame, listed: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
        """file, status of what differs: listed changes (file, status) as they
        are; else what git says (text of name-status or status --porcelain, as
        git.changed_files gives it), by the ignore rules and extensions; else by
        hashes."""
        if listed is not None:
            return listed.select("file", "status")
        if status is not None:
            wanted = file_source.extension(F.col("file")).isin(*self.tracked) & ~file_source.ignored(F.col("file"))
            return status.select("file", "status").filter(wanted)
        return drift.hash_diff(self.store.read("file_hashes"), files.select("file", "hash"))

    def update(self, files: DataFrame, built: str, now: int | None = None, commit: str | None = None, documents: str | None = None, batch: tuple[str, int] | None = None, **found: DataFrame) -> str:
        """Bring the index to the state of files: what differs is parsed, and
        what it can touch linked; only the parts of buckets with rows that change
        are written. batch: a stream and the number of its micro-batch, of which a
        replay publishes nothing."""
        with self.store.lease() as lease:
            before = self.store.number()
            if not before:
                raise ValueError("there is no index to update")
            changes = cut(self.changes(files, **found).select("file", "status"))
            if batch and self.store.applied(batch):
                name = self.store.current()
                touched = relink.of_files(self.store.read("units", self.store.buckets_of(changes)), changes).select("id")
            else:
                name, touched = self._apply(files, changes, built, before, lease, batch)
            self._after(touched, now, commit, documents, batch)
        return name

    def _apply(self, files: DataFrame, changes: DataFrame, built: str, before: int, lease, batch) -> tuple[str, DataFrame]:
        """The new snapshot's name, and the units (id) of changed files."""
        now = cut(files.join(changes.filter("status <> 'D'").select("file"), "file", "left_semi").select("file", "content", "hash"))
        parsed = cut(parse.parse(now))
        units, captures = cut(parse.units_of(parsed)), parse.captures_of(parsed)
        old = lambda table, buckets=None: self.store.read(table, buckets, stored=True)
        done = relink.change(old("units"), old("captures"), changes, units, captures)
        own = self.store.buckets_of(changes)
        linked = own | self.store.buckets_of(done.captures.select("file"))
        kept = lambda table: relink.without_files(old(table, own), changes)
        hashes = cut(relink.without_files(old("file_hashes"), changes).unionByName(now.select("file", "hash")))
        touched = cut(relink.of_files(old("units", own), changes).select("id").union(units.select("id")).distinct())
        new = {
            "units": kept("units").unionByName(units),
            "captures": kept("captures").unionByName(relink.with_names(captures)),
            "edges": done.removed(old("edges", linked)).unionByName(done.edges),
            "vectors": kept("vectors").unionByName(self._embedded(units)),
            "file_hashes": kept("file_hashes").unionByName(now.select("file", "hash")),
            "meta": self._meta(hashes, built),
        }
        buckets = {table: linked if table == "edges" else own for table in new if table != "meta"}
        return self.store.publish(new, buckets=buckets, based_on=before, lease=lease, batch=batch), touched

    def on_batch(self, files, built, stream: str = "changes", **how):
        """For velocity.watch_changes, whose frames are changes (file, status):
        an update of each micro-batch, once. files() and built() give the files
        and the time then."""
        return lambda frame, number: self.update(files(), built(), batch=(stream, number), listed=frame, **how)

    def _after(self, touched: DataFrame | None, now: int | None, commit: str | None, documents: str | None, batch: tuple[str, int] | None = None) -> None:
        now = int(time.time()) if now is None else now
        self.decay(now, touched)
        self.snapshot_health(now, commit, batch)
        if documents is not None:
            self.area_documents().write.mode("overwrite").json(documents)

    def validate(self, files: DataFrame) -> DataFrame:
        """file, status, drift of what differs between the index and files."""
        changes = self.changes(files)
        own = parse.units_of(parse.parse(files.join(changes.select("file"), "file", "left_semi")))
        old = self.units.join(changes.select("file"), "file", "left_semi")
        return drift.classify(changes, drift.unit_drift(old, own))

    def exit_code(self, files: DataFrame) -> int:
        """Of a check of files against the index: 1 for structural drift."""
        return sinks.exit_code(drift.verdict(self.validate(files)))

    def map_is_current(self, text: str) -> bool:
        """Whether a map of areas that was pulled is of the index's state."""
        return sinks.map_is_current(text, self._state())

    def _state(self) -> str:
        row = self.store.read("meta").filter("key = 'state_hash'").first()
        return row["value"] if row else ""

    def migrate(self, steps: dict, wanted: int = schema.SCHEMA_VERSION) -> list[int]:
        """Bring an index of an older version to this one: steps has for each
        version a function of the store that returns the tables of the next. All
        are published as one snapshot; the versions passed are returned."""
        with self.store.lease() as lease:
            found, before = self.store.manifest()["version"], self.store.number()
            todo = sinks.migration_steps(found, wanted, list(steps))
            tables = {}
            for version in todo:
                tables |= steps[version](self.store)
            if todo:
                meta = self.store.read_any("meta", schema.META).filter("key <> 'schema_version'").union(self.spark.createDataFrame([("schema_version", str(wanted))], schema.META))
                whole = {table: tables.get(table, self.store.read_any(table, ddl + (f", {STORED[table]}" if table in STORED else ""))) for table, ddl in TABLES.items() if table != "meta"}
                self.store.publish(whole | {"meta": meta}, files=whole["file_hashes"].count(), based_on=before, lease=lease)
            return todo

    # --------------------------------------------------------------- lookups

    def target(self, name: str) -> DataFrame:
        return reports.resolve(self.units, name)

    def find(self, **by) -> DataFrame:
        return sinks.find_units(self.units, **by)

    def list_areas(self) -> DataFrame:
        """area, path, units of each configured area."""
        table = self.area_table()
        n = area_rules.like_prefix(self.units.select("file"), table).groupBy("area").agg(F.count("*").alias("units"))
        return table.select(F.col("name").alias("area"), "path").join(n, "area", "left").na.fill(0, ["units"])

    def area_table(self) -> DataFrame:
        return self.spark.createDataFrame(area_rules.configured(self.areas), "name string, path string")

    def area_documents(self) -> DataFrame:
        """area, text: each area's document, and `map` for the whole."""
        whole = sinks.area_map(self.units, self.area_table(), self._state()).select(F.lit("map").alias("area"), "text")
        return sinks.area_documents(self.units, self.edges, self.area_table()).union(whole)

    def _query_vector(self, text: str):
        if self.embed is None:
            raise ValueError("there is no embedding model to search by text")
        return self.spark.range(1).select(self.embed(F.lit(text))).first()[0]

    def search(self, query, k: int = schema.TOP_K, area: str | None = None) -> DataFrame:
        """By a vector, or by text through the embedding in use; then only what
        is in areas whose name holds the text."""
        query = self._query_vector(query) if isinstance(query, str) else query
        return vectors.hybrid(self.store.read("vectors"), self.units, self.edges, query, k, self.areas, area=area)

    def context(self, query, texts: DataFrame, budget: int = schema.BUDGET) -> DataFrame:
        found = self.search(query, 20).select("id", "similarity", (F.col("source") == "matched").alias("is_seed"))
        return context.fill(context.candidates(found, texts), budget)

    # --------------------------------------------------------------- reports

    def caller_closure(self, targets: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
        """Of targets, of the units of changed files (file), or of all units."""
        if files is not None:
            targets = reports.units_of_files(self.units, files)
        return reports.closure_risk(self.units, self.edges, targets)

    def impact(self, target: str, depth: int = schema.DEPTH) -> DataFrame:
        return reports.impact(self.units, self.edges, self.target(target), depth)

    def sequence(self, target: str) -> DataFrame:
        return reports.refactor_sequence(self.units, self.edges, self.target(target))

    def health(self) -> DataFrame:
        return health.metrics(self.units, self.edges, self.areas)

    def confidence(self, files: DataFrame, age: float) -> DataFrame:
        return confidence.state(self.units, self.edges, files, self.changes(files), list(self.tracked), age)

    def decorated(self, rows: DataFrame, files: DataFrame, age: float, intents: DataFrame | None = None) -> DataFrame:
        """Any result's rows as JSON with the confidence, and with the intent for
        its areas where there is one and the rows name them."""
        state = self.confidence(files, age).select("confidence", "caveats", "recommendation")
        if intents is not None and "area" in rows.columns:
            rows = intent.enrich(rows.withColumn("areas", F.array("area")), intents)
        return intent.inject(rows, state)

    def silo(self, line_authors: DataFrame, top: int = schema.TOP, now: int | None = None, **filters) -> DataFrame:
        """now: the time of notes on the high rows, if these are to be written."""
        out = reports.top(reports.silos(self.units, self.edges, line_authors), "silo_score", top, **filters)
        if now is not None:
            self.remember(notes.from_report(out, "silo", "silo_score", now))
        return out

    def coverage_gap(self, commits: DataFrame, at, covered: DataFrame | None = None, top: int = schema.TOP, now: int | None = None, **filters) -> DataFrame:
        lines = None if covered is None or covered.isEmpty() else reports.covered_by_lines(self.units, covered)
        own = lines if lines is not None else reports.covered_by_graph(self.units, self.edges)
        out = reports.top(reports.coverage_gaps(self.units, self.edges, own, reports.file_velocity(commits, at)), "gap_score", top, **filters)
        if now is not None:
            self.remember(notes.from_report(out, "gap", "gap_score", now))
        return out

    def vuln(self, package: str, pinned: str | None = None, now: int | None = None) -> DataFrame:
        direct = reports.package_callers(self.units, self.edges, package)
        exposed = reports.exposure(self.units, self.edges, direct)
        if now is not None:
            self.remember(notes.from_package(direct, exposed, package, now))
        return reports.remediation(exposed, package, pinned)

    def onboard(self, intents: DataFrame | None = None) -> dict[str, DataFrame]:
        return onboarding.plan(self.units, self.edges, self.areas, notes=self.store.read("notes"), intent=intents)

    def viz_graph(self) -> tuple[DataFrame, DataFrame]:
        return viz.viz_nodes(self.units, self.edges, self.areas), viz.viz_edges(self.units, self.edges, self.areas)

    # ----------------------------------------------------------------- notes

    def list_notes(self, **filters) -> DataFrame:
        return notes.list_notes(self.store.read("notes"), **filters)

    def remember(self, rows: DataFrame) -> None:
        rows = cut(rows)
        self._known(rows, "type", schema.NOTE_TYPES)
        self.store.append("notes", rows)
        if self.embed is not None:
            self.store.append("note_vectors", self._embed_notes(rows))

    @staticmethod
    def _known(rows: DataFrame, name: str, values: tuple[str, ...]) -> None:
        odd = rows.filter(~F.coalesce(F.col(name).isin(*values), F.lit(False))).first()
        if odd is not None:
            raise ValueError(f"{name} {odd[name]!r} is none of {', '.join(values)}")

    def forget(self, ids: DataFrame) -> None:
        """Delete notes (id), their vectors and the edges at them."""
        ids = cut(ids.select("id").distinct())
        edges = notes.without(notes.without(self.store.read("note_edges"), ids, "from_id"), ids, "to_id")
        # The notes go last: until then a repeated call finds them.
        for table, rows in (("note_edges", edges), ("note_vectors", notes.without(self.store.read("note_vectors"), ids)), ("notes", notes.without(self.store.read("notes"), ids))):
            self.store.replace(table, rows)

    def link(self, rows: DataFrame) -> None:
        """Upsert note edges, whose ends have to be notes."""
        rows = cut(rows)
        self._known(rows, "rel_type", schema.NOTE_RELATIONS)
        bad = notes.dangling(rows, self.store.read("notes")).first()
        if bad is not None:
            raise ValueError(f"no such note: {bad['from_id']} or {bad['to_id']}")
        self.store.replace("note_edges", notes.upsert_edges(self.store.read("note_edges"), rows))

    def export_notes(self, **filters) -> DataFrame:
        return notes.to_markdown(self.list_notes(**filters))

    def recall(self, query: str, limit: int = schema.RECALL, **filters) -> DataFrame:
        return notes.recall(self.store.read("notes"), self.store.read("note_vectors"), self._query_vector(query), limit, **filters)

    def trace(self, start: DataFrame, depth: int = schema.TRACE_DEPTH) -> DataFrame:
        return graph.note_ancestry(self.store.read("note_edges"), start, depth)

    def decay(self, now: int, changed: DataFrame | None = None) -> int:
        """Recompute the notes' decay; notes on changed units (id) pay for it.
        How many have changed."""
        before = self.store.read("notes")
        if before.isEmpty():
            return 0
        after = cut(notes.recompute_decay(before, now, changed, self.half_life, stale=self.stale, possibly=self.possibly_stale))
        n = notes.changed_rows(before, after).first()["changed"]
        if n:
            self.store.replace("notes", after)
        return n

    # --------------------------------------------------------------- history

    def snapshot_health(self, now: int, commit: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """Append the metrics to the history, which later builds keep."""
        row = cut(self.health())
        current = row.first()["unit_count"]
        v = cut(health.drift_velocity(self.store.read("health"), current, now))
        self.store.append("health", row.crossJoin(v).withColumn("build_ts", F.lit(now).cast("long")).withColumn("commit_hash", F.lit(commit).cast("string")), batch)  # one row each

    def health_history(self, metric: str) -> DataFrame:
        if metric not in health.METRICS:
            raise ValueError(f"{metric!r} is none of {', '.join(health.METRICS)}")
        return health.deltas(self.store.read("health"), metric)


