"""Tables with vector columns as Parquet snapshots.

A table is a list of segments, directories of Parquet files that never change, and a small manifest per
version that names them. Inserting writes one new segment; updating and deleting rewrite the segments that they touch
into a new one; compacting joins segments, and what no version in use names is removed. A commit writes the next
manifest, so readers keep the version that they opened. Paths may be on any file system that Spark reads; there is one
writer at a time.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semql.functions.embedders import Embedder, NullEmbedder, embed_column, embed_one
from semql.functions.vectors import dot, literal
from semql.metrics import Metrics
from semql.operators.ann import CellIndex, fit
from semql.operators.scan import CAP, ROWID, THRESHOLD, VectorTable


class StoreError(ValueError):
    def __init__(self, what: str):
        super().__init__(f"semql: {what}")


#: Declared types by their first word; anything else is text.
_TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType()}


@dataclass
class ColumnDef:
    name: str
    decl_type: str = ""
    vector: bool = False

    @property
    def type(self) -> T.DataType:
        return _TYPES.get((self.decl_type.upper().split() or [""])[0], T.StringType())

    @classmethod
    def of(cls, text: str) -> ColumnDef:
        """From ``name [type] [VECTOR]``; the name may be quoted."""
        found = re.fullmatch(r'\s*(?:"([^"]+)"|`([^`]+)`|\[([^\]]+)\]|(\S+))\s*(.*?)\s*', text, re.DOTALL)
        if not found:
            raise StoreError(f"not a column definition: '{text}'")
        words = found[5].split()
        kept = [w for w in words if w.upper() != "VECTOR"]
        return cls(next(x for x in found.groups()[:4] if x), " ".join(kept), len(kept) < len(words))


@dataclass
class Manifest:
    columns: list[ColumnDef]
    model_id: str = ""
    dim: int = 0
    next_rowid: int = 1
    segments: list[str] = field(default_factory=list)
    dropped: bool = False

    def vectors(self) -> list[str]:
        return [c.name for c in self.columns if c.vector]

    def schema(self) -> T.StructType:
        out = T.StructType([T.StructField(ROWID, T.LongType())])
        for c in self.columns:
            out = out.add(T.StructField(c.name, c.type, metadata={"vector": c.vector, "decl_type": c.decl_type}))
        for v in self.vectors():
            out = out.add(T.StructField(f"_emb_{v}", T.ArrayType(T.FloatType())))
        return out


class Database:
    """Vector tables under one root directory. Without ``begin`` every statement commits by itself."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, threshold: float = THRESHOLD, cap: int = CAP):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder or NullEmbedder()
        self.threshold, self.cap, self.metrics = threshold, cap, Metrics()
        self._stack: list[tuple[str | None, dict[str, Manifest]]] = []
        self._indexes: dict[tuple[str, str], dict] = {}

    # Small files, by Hadoop's file system of the root.
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _write(self, path: str, text: str) -> None:
        """All of the file or nothing: a rename makes it visible, and fails if another writer came first."""
        fs, p = self._fs(path)
        _, draft = self._fs(f"{path}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise StoreError(f"another writer has committed {path}")

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # Manifests.
    def _versions(self, name: str) -> list[str]:
        return [v for v in self._list(f"{self.root}/{name}/_manifests") if v.endswith(".json")]

    def _committed(self, name: str) -> Manifest | None:
        versions = self._versions(name)
        if not versions:
            return None
        raw = json.loads(self._read(f"{self.root}/{name}/_manifests/{versions[-1]}"))
        found = Manifest(**{**raw, "columns": [ColumnDef(**c) for c in raw["columns"]]})
        return None if found.dropped else found

    def _manifest(self, name: str) -> Manifest:
        found = next((state[name] for _, state in reversed(self._stack) if name in state), None) or self._committed(name)
        if found is None or found.dropped:
            raise StoreError(f"no such table: {name}")
        return found

    def _publish(self, name: str, manifest: Manifest) -> None:
        number = len(self._versions(name)) + 1
        self._write(f"{self.root}/{name}/_manifests/{number:012d}.json", json.dumps(asdict(manifest)))

    def _save(self, name: str, manifest: Manifest) -> None:
        if self._stack:
            self._stack[-1][1][name] = manifest
        else:
            self._publish(name, manifest)

    # Transactions: a stack of changed manifests, the transaction at the bottom and savepoints above.
    def begin(self) -> None:
        if self._stack:
            raise StoreError("a transaction is open already")
        self._stack.append((None, {}))

    def commit(self) -> None:
        if not self._stack:
            raise StoreError("no transaction is open")
        changed: dict[str, Manifest] = {}
        for _, state in self._stack:
            changed |= state
        self._stack = []
        for name, manifest in changed.items():
            self._publish(name, manifest)

    def rollback(self) -> None:
        if not self._stack:
            raise StoreError("no transaction is open")
        self._stack = []

    def savepoint(self, label: str) -> None:
        if not self._stack:
            self.begin()
        self._stack.append((label, {}))

    def _find(self, label: str) -> int:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == label:
                return i
        raise StoreError(f"no such savepoint: {label}")

    def release(self, label: str) -> None:
        """Changes since the savepoint become those of what is around it."""
        i = self._find(label)
        for _, state in self._stack[i:]:
            self._stack[i - 1][1].update(state)
        del self._stack[i:]

    def rollback_to(self, label: str) -> None:
        """Undo what came after the savepoint, which stays."""
        i = self._find(label)
        self._stack[i:] = [(label, {})]

    # Definition.
    def create_table(self, name: str, *columns: str) -> None:
        """``columns`` as ``name [type] [VECTOR]``. A table that was dropped keeps none of its rows."""
        if not columns:
            raise StoreError("a table needs a column")
        if name in self.tables():
            raise StoreError(f"table {name} exists")
        self._save(name, Manifest([ColumnDef.of(c) for c in columns], self.embedder.model_id, self.embedder.dim))

    def drop_table(self, name: str) -> None:
        self._save(name, Manifest(self._manifest(name).columns, dropped=True))

    def tables(self) -> list[str]:
        names = {n for n in self._list(self.root) if self._versions(n)} | {n for _, s in self._stack for n in s}
        out = []
        for n in sorted(names):
            try:
                self._manifest(n)
                out.append(n)
            except StoreError:
                pass
        return out

    def describe(self, name: str) -> list[tuple[str, str, bool]]:
        """Name, declared type and whether it is a vector column, of each column."""
        return [(c.name, c.decl_type, c.vector) for c in self._manifest(name).columns]

    # Reading.
    def rows(self, name: str) -> DataFrame:
        manifest = self._manifest(name)
        reader = self.spark.read.schema(manifest.schema())
        return reader.parquet(*manifest.segments) if manifest.segments else self.spark.createDataFrame([], manifest.schema())

    def table(self, name: str) -> VectorTable:
        """The current version. A table built with another model can't be searched."""
        manifest = self._manifest(name)
        ours, theirs = self.embedder, manifest
        if ours.dim and theirs.dim and (ours.dim != theirs.dim or (ours.model_id and theirs.model_id and ours.model_id != theirs.model_id)):
            raise StoreError(
                f"the vectors of {name} are of '{theirs.model_id}' with {theirs.dim} dimensions and can't be searched with '{ours.model_id}' of {ours.dim}: reindex required"
            )
        names = {v: f"_emb_{v}" for v in manifest.vectors()}
        return VectorTable(self.rows(name), names, self.embedder, ROWID, self.threshold, self.cap, self.metrics, counted=True)

    def search_index(self, name: str, column: str, **options) -> tuple[CellIndex, DataFrame]:
        """The approximate index of a column, and the rows by cell, pruned by it.

        It is built at the first search after a change and kept beside the table, so that later sessions find it; the copy
        that it replaces is removed.
        """
        manifest = self._manifest(name)
        note, found = f"{self.root}/{name}/_index/{column}.json", self._indexes.get((name, column))
        if found is None and self._exists(note):
            found = json.loads(self._read(note))
        if found is None or found["segments"] != manifest.segments or found["options"] != repr(sorted(options.items())):
            began = time.perf_counter()
            rows = self.rows(name).where(F.col(f"_emb_{column}").isNotNull())
            index = fit(rows, f"_emb_{column}", ROWID, **options)
            path = f"{self.root}/{name}/_index/{uuid.uuid4().hex}"
            index.assign(rows.select(ROWID, f"_emb_{column}"), f"_emb_{column}").write.partitionBy("cell").parquet(path)
            old, found = found, {"segments": manifest.segments, "options": repr(sorted(options.items())), "path": path, "probes": index.probes, "centroids": index.centroids.tolist()}
            self._delete(note)
            self._write(note, json.dumps(found))
            if old is not None:
                self._delete(old["path"])
            self.metrics.index_rebuilds += 1
            self.metrics.index_rebuild_ms += (time.perf_counter() - began) * 1000
        self._indexes[name, column] = found
        schema = T.StructType([T.StructField(ROWID, T.LongType()), T.StructField(f"_emb_{column}", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType())])
        return CellIndex(np.asarray(found["centroids"], np.float32), found["probes"]), self.spark.read.schema(schema).parquet(found["path"])

    def approximate(self, name: str, column: str, text: str, k: int = CAP) -> DataFrame:
        """``_rowid`` and ``score`` of the best ``k`` rows in the cells near the query, at the threshold or above."""
        vector = embed_one(text, self.embedder, self.metrics)
        if vector is None:
            return self.spark.createDataFrame([], "_rowid long, score double")
        index, rows = self.search_index(name, column)
        cells = [int(c) for c in index.nearest_cells(vector)]
        scored = rows.where(F.col("cell").isin(cells)).select(ROWID, dot(F.col(f"_emb_{column}"), literal(vector)).alias("score"))
        return scored.orderBy(F.desc("score"), ROWID).limit(k).where(F.col("score") >= self.threshold)

    # Writing.
    def _segment(self, name: str, rows: DataFrame, embedded: list[Column] | None = None, drop: Sequence[str] = ()) -> str:
        """Write a segment; ``embedded`` is true of rows whose texts were embedded on the way, which are counted."""
        began = time.perf_counter()
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        seen = Observation()
        if embedded:
            rows = rows.observe(seen, *[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(embedded)])
        rows.drop(*drop).write.parquet(path)
        ms = (time.perf_counter() - began) * 1000
        if embedded:  # making and writing vectors is one job, so its time is given to both
            self.metrics.embed_calls += sum(seen.get.values())
            self.metrics.embed_ms += ms
        self.metrics.persist_ms += ms
        return path

    def _typed(self, manifest: Manifest, rows: DataFrame) -> DataFrame:
        """Declared columns in their types: BINARY becomes null, missing ones are null."""
        kinds = {f.name: f.dataType for f in rows.schema}
        unknown = set(kinds) - {c.name for c in manifest.columns} - {ROWID}
        if unknown:
            raise StoreError(f"no such column: {sorted(unknown)[0]}")
        value = lambda c: F.lit(None).cast(c.type) if isinstance(kinds.get(c.name, T.NullType()), T.BinaryType | T.NullType) else F.col(f"`{c.name}`").cast(c.type)
        own = [F.col(ROWID).cast("long").alias(ROWID)] if ROWID in kinds else []
        return rows.select(*own, *[value(c).alias(c.name) for c in manifest.columns])

    def _embedded(self, manifest: Manifest, rows: DataFrame) -> DataFrame:
        none = F.lit(None).cast("array<float>")
        vector = lambda v: embed_column(F.col(f"`{v}`"), self.embedder) if self.embedder.dim else none
        return rows.withColumns({f"_emb_{v}": vector(v) for v in manifest.vectors()}).select(*[f"`{c}`" for c in manifest.schema().names])

    def insert(self, name: str, rows: DataFrame | list[dict]) -> int:
        """Add rows; a ``_rowid`` that exists is replaced, missing ones continue from the last. Returns how many came in.

        Of rows that bring the same ``_rowid`` the last one stays. Rows without one get theirs after all that are
        there or brought along.
        """
        manifest = self._manifest(name)
        if isinstance(rows, list):
            given = T.StructType([T.StructField(ROWID, T.LongType())] * any(ROWID in r for r in rows) + [T.StructField(c.name, c.type) for c in manifest.columns if any(c.name in r for r in rows)])
            for r in rows:
                if set(r) - set(given.names):
                    raise StoreError(f"no such column: {sorted(set(r) - set(given.names))[0]}")
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in given.names) for r in rows], given)
        typed = self._typed(manifest, rows)
        supplied = ROWID in typed.columns
        typed = typed if supplied else typed.withColumn(ROWID, F.lit(None).cast("long"))
        staging = self._segment(name, numbered(typed))
        staged = self.spark.read.parquet(staging)
        # Row ids follow on from part to part: a few numbers for each written part are all that the driver sees.
        counts = staged.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n"), F.count("__place").alias("missing"), F.max(ROWID).alias("top"))
        parts = sorted((r.part, r.missing, r.top, r.n) for r in counts.collect())
        first = max([manifest.next_rowid, *(top + 1 for _, _, top, _ in parts if top is not None)])
        starts, at = [], first
        for part, missing, _, _ in parts:
            starts.append((part, at))
            at += missing
        offsets = F.broadcast(self.spark.createDataFrame(starts or [(0, 0)], "__part int, __start long"))
        placed = staged.join(offsets, "__part").withColumn(ROWID, F.coalesce(ROWID, F.col("__start") + F.col("__place")))
        if supplied:
            placed = _last(placed)
        embedded = [F.col(f"`_emb_{v}`").isNotNull() for v in manifest.vectors()]
        segment = self._segment(name, self._embedded(manifest, placed.drop("__part", "__place", "__line", "__start")), embedded if self.embedder.dim else None)
        self._delete(staging)
        segments = list(manifest.segments)
        if supplied and segments:
            own = self._of(manifest, [segment]).select(F.col(ROWID).alias("__new"))
            if not self.rows(name).join(own, F.col(ROWID) == F.col("__new"), "left_semi").isEmpty():
                kept = self.rows(name).join(own, F.col(ROWID) == F.col("__new"), "left_anti").select(*manifest.schema().names)
                segments = [self._segment(name, kept)]
        self._save(name, Manifest(manifest.columns, manifest.model_id, manifest.dim, at, [*segments, segment]))
        return sum(n for *_, n in parts)

    def _touched(self, name: str, where: Column | None) -> tuple[list[str], list[str]]:
        """Segments with a row for which the condition is true, and the others, which stay as they are."""
        segments = self._manifest(name).segments
        if where is None or len(segments) < 2:
            return segments, []
        of = F.regexp_extract(F.input_file_name(), r"/([0-9a-f]{32})/[^/]*$", 1)
        hit = {r[0] for r in self.rows(name).where(where).select(of).distinct().collect()}  # at most one row a segment
        touched = [s for s in segments if s.rpartition("/")[2] in hit]
        return touched, [s for s in segments if s not in touched]

    def _of(self, manifest: Manifest, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(manifest.schema()).parquet(*segments)

    def update(self, name: str, changes: dict[str, Column | object], where: Column | None = None) -> None:
        """Set columns where the condition holds, and embed the changed texts again; only segments with such rows are written anew.

        ``_rowid`` may be set too (null leaves it): a row that moves onto another's id replaces it, unless that one moves
        away as well; of several that move onto one id, the one that had the largest stays.
        """
        manifest = self._manifest(name)
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        kinds = {f.name: f.dataType for f in manifest.schema()}
        unknown = set(changes) - set(kinds)
        if unknown:
            raise StoreError(f"no such column: {sorted(unknown)[0]}")
        value = lambda c: changes[c] if isinstance(changes[c], Column) else F.lit(changes[c])
        touched, kept = (manifest.segments, []) if ROWID in changes else self._touched(name, where)
        if not touched:
            return
        marked = self._of(manifest, touched).withColumn("__hit", hit)
        set_ = lambda c: F.when(F.col("__hit"), value(c)).otherwise(F.col(f"`{c}`")) if c in changes else F.col(f"`{c}`")
        new = marked.select("__hit", F.col(ROWID).alias("__old"), *[set_(c).cast(kinds[c]).alias(c) for c in kinds])
        fresh = [v for v in manifest.vectors() if v in changes or not self.embedder.dim]
        for v in fresh:
            vector = embed_column(F.col(f"`{v}`"), self.embedder) if self.embedder.dim else F.lit(None).cast("array<float>")
            new = new.withColumn(f"_emb_{v}", F.when(F.col("__hit"), vector).otherwise(F.col(f"`_emb_{v}`")))
        next_rowid = manifest.next_rowid
        if ROWID in changes:
            new = new.withColumn(ROWID, F.coalesce(ROWID, "__old"))
            moves = F.col(ROWID) != F.col("__old")
            moved = new.where(moves).groupBy(F.col(ROWID).alias("__id")).agg(F.max("__old").alias("__from"))
            new = new.join(moved, F.col(ROWID) == F.col("__id"), "left").where(F.col("__id").isNull() | (moves & (F.col("__old") == F.col("__from"))))
        seen = [F.col("__hit") & F.col(f"`_emb_{v}`").isNotNull() for v in fresh] if self.embedder.dim else None
        segment = self._segment(name, new, seen, drop=["__hit", "__old", "__id", "__from"])
        if ROWID in changes:
            next_rowid = max(next_rowid, (self._of(manifest, [segment]).agg(F.max(ROWID)).first()[0] or 0) + 1)
        self._save(name, Manifest(manifest.columns, manifest.model_id, manifest.dim, next_rowid, [*kept, segment]))

    def delete(self, name: str, where: Column | None = None) -> None:
        """Remove the rows for which the condition is true; only segments with such rows are written anew."""
        manifest = self._manifest(name)
        segments: list[str] = []
        if where is not None:
            touched, segments = self._touched(name, where)
            if not touched:
                return
            segments = [*segments, self._segment(name, self._of(manifest, touched).where(~F.coalesce(where, F.lit(False))))]
        self._save(name, Manifest(manifest.columns, manifest.model_id, manifest.dim, manifest.next_rowid, segments))

    def reindex(self, name: str) -> None:
        """Embed all rows again with the current model."""
        manifest = self._manifest(name)
        plain = self.rows(name).select(ROWID, *[f"`{c.name}`" for c in manifest.columns])
        embedded = [F.col(f"`_emb_{v}`").isNotNull() for v in manifest.vectors()]
        segment = self._segment(name, self._embedded(manifest, plain), embedded if self.embedder.dim else None)
        self._save(name, Manifest(manifest.columns, self.embedder.model_id, self.embedder.dim, manifest.next_rowid, [segment]))

    def compact(self, name: str) -> None:
        """One segment from all: many small inserts, as of a stream, leave as many."""
        manifest = self._manifest(name)
        if len(manifest.segments) > 1:
            self._save(name, Manifest(manifest.columns, manifest.model_id, manifest.dim, manifest.next_rowid, [self._segment(name, self.rows(name))]))

    def vacuum(self, name: str, versions: int = 1) -> int:
        """Remove segments that none of the last ``versions`` committed versions names; readers of older ones lose them. Returns how many."""
        if self._stack:
            raise StoreError("a transaction is open")
        read = lambda v: json.loads(self._read(f"{self.root}/{name}/_manifests/{v}"))["segments"]
        named = {s.rpartition("/")[2] for v in self._versions(name)[-versions:] for s in read(v)}
        gone = [d for d in self._list(f"{self.root}/{name}") if re.fullmatch("[0-9a-f]{32}", d) and d not in named]
        for d in gone:
            self._delete(f"{self.root}/{name}/{d}")
        return len(gone)


def _last(placed: DataFrame) -> DataFrame:
    """Of rows with one id, the last by part and line. Ids that come once, as nearly all do, aren't gathered by id with their rows."""
    at = F.struct("__part", "__line")
    twice = placed.groupBy(F.col(ROWID).alias("__id")).agg(F.count("*").alias("__n"), F.max(at).alias("__last")).where(F.col("__n") > 1)
    found = placed.join(twice, F.col(ROWID) == F.col("__id"), "left").where(F.col("__id").isNull() | (at == F.col("__last")))
    return found.drop("__id", "__n", "__last")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with the number of their partition, their line in it, and their place among those of it without a row id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, line, seen = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            missing = np.asarray(batch.column(ROWID).is_null())
            lines = pa.array(np.arange(line, line + len(missing)))
            places = pa.array(np.cumsum(missing) - 1 + seen, mask=~missing)
            line, seen = line + len(missing), seen + int(missing.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(missing), part, np.int32)), lines, places], names=[*batch.schema.names, "__part", "__line", "__place"])

    schema = T.StructType([*rows.schema, T.StructField("__part", T.IntegerType()), T.StructField("__line", T.LongType()), T.StructField("__place", T.LongType())])
    return rows.mapInArrow(run, schema)
