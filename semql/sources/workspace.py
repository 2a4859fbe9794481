"""The client API: databases in a workspace, queries with metrics, single-row edits, scripts, notes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semql import __version__
from semql.functions.embedders import Embedder, embed_one, embed_udf, scaled_udf
from semql.metrics import Metrics
from semql.operators.matchdsl import APPROXIMATE, EXACT
from semql.operators.scan import CAP, ROWID, THRESHOLD, Match, VectorTable
from semql.sources.store import Database, StoreError

PAGE = 500
#: Between the cheap part of a script and its rows with vectors.
MARKER = "--==VECTORS==--"


@dataclass
class QueryResult:
    """A planned query. Times and counters are complete once ``rows`` has run it; until then they are of its planning."""

    df: DataFrame
    counters: Metrics
    before: dict
    elapsed_ms: float = 0.0

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def metrics(self) -> dict:
        """What was counted since the query was given."""
        return self.counters.since(self.before)

    def rows(self) -> list[tuple]:
        began = time.perf_counter()
        found = [tuple(r) for r in self.df.collect()]
        ms = (time.perf_counter() - began) * 1000
        self.elapsed_ms += ms
        if self.metrics["search_ops"]:
            self.counters.ran(ms)
        return found


def register_functions(spark: SparkSession, embedder: Embedder) -> None:
    """``semql_version()``, ``semql_model()`` and ``semql_dim()`` for SQL, null where there is no model, and ``semql_dot(a, b)``."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    model = f"cast({quote(embedder.model_id)} AS string)" if embedder.model_id else "cast(NULL AS string)"
    dim = f"cast({embedder.dim} AS bigint)" if embedder.dim else "cast(NULL AS bigint)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION semql_version() RETURNS string RETURN {quote(__version__)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION semql_model() RETURNS string RETURN {model}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION semql_dim() RETURNS bigint RETURN {dim}")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION semql_dot(a ARRAY<FLOAT>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN aggregate(zip_with(a, b, (x, y) -> coalesce(double(x) * double(y), 0D)), 0D, (t, x) -> t + x)""")
    # As ``vectors.exact_dot``; both sides have a vector and its length.
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION semql_exact_dot(a ARRAY<FLOAT>, n DOUBLE, b ARRAY<FLOAT>, m DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN n IS NULL OR m IS NULL THEN aggregate(zip_with(a, b, (x, y) -> coalesce(double(x) * double(y), 0D)), 0D, (t, x) -> t + x)
            WHEN n > 0 AND m > 0 THEN aggregate(zip_with(a, b, (x, y) -> coalesce(rint(double(x) * n) * rint(double(y) * m), 0D)), 0D, (t, x) -> t + x) / n / m
            WHEN a IS NOT NULL AND b IS NOT NULL THEN 0D END""")
    spark.udf.register("semql_embed", embed_udf(embedder))
    spark.udf.register("semql_scaled", scaled_udf(embedder))


def register_search(spark: SparkSession, view: str, table: VectorTable, threshold: float = THRESHOLD, cap: int = CAP) -> None:
    """MATCH for SQL: two table functions for each vector column of ``table``, which ``view`` shows with its vectors.

    ``<view>_<column>_match(text, candidates, least)`` has the best ``candidates`` rows of those at ``least`` or above and
    ``<view>_<column>_exact(text, least)`` all of them; both with the row id, the columns and ``<column>_score``. The text is
    embedded once a call; null and blank ones give no rows. Conditions beside a call see what the cap has left.
    """
    kinds = {f.name: f.dataType.simpleString() for f in table.df.schema}
    shown = ", ".join(f"`{c}`" for c in table.columns)
    returns = ", ".join([f"rowid {kinds[table.rowid]}", *(f"`{c}` {kinds[c]}" for c in table.columns)])
    for column, vector in table.embeddings.items():
        score = table.score_name(column)
        length = f"`{table.lengths[column]}`" if column in table.lengths else "CAST(NULL AS DOUBLE)"
        for kind, extra in (("match", f"candidates INT DEFAULT {cap}, "), ("exact", "")):
            name = f"`{view}_{column}_{kind}`"
            # The text's vector is a table of one row, so it is made once.
            scored = f"SELECT *, semql_exact_dot(`{vector}`, {length}, __query.vector, __query.length) AS `{score}` FROM `{view}_data` JOIN (SELECT semql_scaled({name}.query) AS __query) ON true"
            place = f"row_number() OVER (ORDER BY `{score}` DESC NULLS LAST, `{table.rowid}`) AS __place, " if extra else ""
            kept = f"__place <= {name}.candidates AND " if extra else ""
            spark.sql(f"""
                CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, {extra}least DOUBLE DEFAULT {float(threshold)}D) RETURNS TABLE ({returns}, `{score}` DOUBLE)
                RETURN SELECT `{table.rowid}`, {shown}, `{score}` FROM (SELECT {place}* FROM ({scored})) WHERE {kept}`{score}` >= {name}.least""")


class Workspace:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.db: Database | None = None
        if embedder is not None:
            register_functions(spark, embedder)

    def _files(self) -> Database:
        return Database(self.spark, self.root)

    def list_databases(self) -> list[str]:
        return [n for n in self._files()._list(self.root) if not n.startswith(("_", "."))]

    def open_database(self, name: str) -> Database:
        self.db = Database(self.spark, f"{self.root}/{name}", self.embedder)
        return self.db

    def drop_database(self, name: str) -> None:
        for path in (f"{self.root}/{name}", f"{self.root}/_notes/{name}"):
            fs, p = self._files()._fs(path)
            fs.delete(p, True)

    def _open(self) -> Database:
        if self.db is None:
            raise StoreError("no database is open")
        return self.db

    def schema(self) -> dict[str, list[tuple[str, str, bool]]]:
        return {t: self._open().describe(t) for t in self._open().tables()}

    def register_views(self) -> None:
        """Every table as a view of its name, and with row ids and vectors as ``<name>_data``."""
        for t in self._open().tables():
            table = self._open().table(t)
            table.star(table.df).createOrReplaceTempView(t)
            table.df.createOrReplaceTempView(f"{t}_data")
            if self._open().embedder.dim:
                register_search(self.spark, t, table, table.threshold, table.cap)
        for name, file in self._view_files().items():
            self.spark.sql(self._open()._read(file)).createOrReplaceTempView(name)

    def _view_files(self) -> dict[str, str]:
        """Views in the order in which they were made, so that each comes after those it uses."""
        db = self._open()
        files = [f for f in db._list(f"{db.root}/_views") if f.endswith(".sql")]
        return {f[7:].removesuffix(".sql"): f"{db.root}/_views/{f}" for f in files}

    def views(self) -> list[str]:
        return list(self._view_files())

    def create_view(self, name: str, sql: str) -> None:
        """A stored SELECT over tables, searches and earlier views, planned anew whenever it is used."""
        db, files = self._open(), self._view_files()
        if name in (*files, *db.tables()):
            raise StoreError(f"{name} exists")
        self.register_views()
        self.spark.sql(sql).schema  # fails now rather than later
        number = max((int(f.rpartition("/")[2][:6]) for f in files.values()), default=0) + 1
        db._write(f"{db.root}/_views/{number:06d}-{name}.sql", sql)

    def drop_view(self, name: str) -> None:
        files = self._view_files()
        if name not in files:
            raise StoreError(f"no such view: {name}")
        self._open()._delete(files[name])

    def query(self, sql: str, args: list | dict | None = None) -> QueryResult:
        """Spark SQL over the tables; ``args`` fill ``?`` or ``:name``.

        Searches are table functions, ``SELECT * FROM tickets_problem_match('card declined') WHERE status = 'open'`` (see
        ``register_search``). A filter before the search is written out over ``<name>_data``, as ``semql_dot(_emb_problem, :q) >= 0.5``
        with ``embed(text)`` for ``:q``, and so is a score used in other ways.
        """
        self.register_views()
        return self._measured(lambda: self.spark.sql(sql, args=args))

    def embed(self, text: str) -> Column:
        """A query's vector as a literal for ``args``; null for a text that has none."""
        vector = embed_one(text, self._open().embedder, self._open().metrics)
        return F.lit(None) if vector is None else F.array(*map(F.lit, vector))

    def _measured(self, make: Callable[[], DataFrame]) -> QueryResult:
        before, began = self._open().metrics.snapshot(), time.perf_counter()
        df = make()
        return QueryResult(df, self._open().metrics, before, (time.perf_counter() - began) * 1000)

    def search(self, table: str, column: str, text: str, limit: int = PAGE, exact: bool = False, candidates: int | None = None) -> QueryResult:
        """The search bar: rows like ``text``, with ``rowid`` and ``_similarity`` at four decimals, the best first."""
        quoted = '"' + text.replace('"', " ") + '"'
        suffix = f"/{EXACT}" if exact else f"/{APPROXIMATE}" + (f":{candidates}" if candidates else "")

        def make() -> DataFrame:
            source = self._open().table(table)
            found = source.scan(Match(column, quoted + suffix)).withColumn("_similarity", F.round(source.score_name(column), 4))
            shown = [F.col(ROWID).alias("rowid"), *[F.col(f"`{c}`") for c in source.columns], "_similarity"]
            return found.orderBy(F.desc("_similarity"), ROWID).limit(limit).select(*shown)

        return self._measured(make)

    def table_data(self, table: str, limit: int = PAGE, offset: int = 0) -> DataFrame:
        return self._open().table(table).page(limit, offset)

    def update_cell(self, table: str, rowid: int, column: str, value: object) -> None:
        self._open().update(table, {column: value}, F.col(ROWID) == rowid)

    def insert_row(self, table: str, values: dict) -> None:
        if not values:
            raise StoreError("a row needs a column")
        self._open().insert(table, [values])

    def delete_row(self, table: str, rowid: int) -> None:
        self._open().delete(table, F.col(ROWID) == rowid)

    def run_script(self, lines: str, on_progress: Callable[[int, int], None] | None = None) -> int:
        """A load script: a JSON object a line, ``{"create": name, "columns": [...]}`` or ``{"insert": name, "rows": [...]}``.

        Rows for one table that follow each other go in together; progress counts those after the marker.
        """
        head, _, tail = lines.partition(MARKER)
        before, after = ([json.loads(x) for x in part.splitlines() if x.strip() and not x.startswith("--")] for part in (head, tail))
        done = 0
        for part in (before, after):
            at = 0
            while at < len(part):
                step = part[at]
                if "create" in step:
                    self._open().create_table(step["create"], *step["columns"])
                    at += 1
                    continue
                rows: list[dict] = []
                while at < len(part) and part[at].get("insert") == step["insert"]:
                    rows += part[at]["rows"]
                    at += 1
                self._open().insert(step["insert"], rows)
                if part is after:
                    done += len(rows)
                    if on_progress:
                        on_progress(done, sum(len(s.get("rows", [])) for s in after))
        return done

    def write_notes(self, name: str, text: str, kind: str = "notes.md") -> None:
        files = self._files()
        fs, p = files._fs(f"{self.root}/_notes/{name}/{kind}")
        fs.delete(p, False)
        files._write(f"{self.root}/_notes/{name}/{kind}", text)

    def read_notes(self, name: str, kind: str = "notes.md") -> str:
        fs, p = self._files()._fs(f"{self.root}/_notes/{name}/{kind}")
        return self._files()._read(f"{self.root}/_notes/{name}/{kind}") if fs.exists(p) else ""
