"""Line dedup: lines that several documents hold stay in the first of them only.

Normalised lines are exploded as 128-bit hashes, distinct documents are counted per hash, and
the positions to drop are gathered per document, whose text is then put together from the kept
positions. The texts are shuffled once, with the dropped positions; the lines travel as hashes, which are
written to the shared folder before they are counted and removed when the positions are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm.common import LOWER, SPACE, UPPER, ascii_lower, cut, drop, let, same, table

#: A second, independent 64-bit hash: the seed of the first differs by what it has hashed before.
_SALT = "line"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses
    all its lines but those of the smallest id.

    Null or empty texts count as one empty line and come back empty. Rows that repeat an id are one
    document where documents are counted, and each keeps its own text. A null id counts as one
    document, before all others. Texts are split whole, however long; their lines are gathered by text, a hash and a
    position each. Other columns pass through; inputs named ``n_lines`` or ``n_dropped`` are replaced. An empty
    table gives an empty table.
    """
    own = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    base = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.xxhash64(F.col(text_col)).alias("__th"))
    lines = base.select(F.col(id_col).alias("__id"), "__th", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    lines = lines.select("__id", "__th", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    lines = lines.select("__id", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(_SALT), "__key").alias("__h2"))
    lines = cut(lines, "line-hashes")  # made once, counted and joined

    # Null ids come first; they are told by a flag, so that ids are aggregated as they are.
    null = F.max(F.col("__id").isNull().cast("int")).alias("__null")
    if min_docs <= 2:  # two different ids are enough to know: no list of documents per key
        held = lines.groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), null)
        several = (F.col("__first") != F.col("__last")) | ((F.col("__null") == 1) & F.col("__first").isNotNull())
        held = held.where(several) if min_docs == 2 else held
    else:
        held = lines.groupBy("__h1", "__h2", "__id").count().groupBy("__h1", "__h2")
        held = held.agg(F.min("__id").alias("__first"), null, F.count("*").alias("__n")).where(F.col("__n") >= min_docs)
    # A table of its own, so that both sides of the join are plain exchanges and a hot line can be split among tasks.
    held = cut(held.select("__h1", "__h2", F.when(F.col("__null") == 0, F.col("__first")).alias("__first_id")), "held-lines")
    gone = lines.join(held, ["__h1", "__h2"]).where(~same(F.col("__id"), F.col("__first_id")))
    gone = cut(gone.groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__drop")), "dropped-lines")
    drop(lines, held)

    out = base.join(gone, same(base[id_col], gone["__id"]) & (base["__th"] == gone["__th"]), "left").drop(gone["__th"])
    pieces = let(
        F.split("__text", "\n", -1),
        lambda a: F.when(F.col("__drop").isNull(), F.struct(F.size(a).alias("n"), F.col("__text").alias("t"))).otherwise(
            F.struct(
                F.size(a).alias("n"),
                F.array_join(
                    F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("__drop")), lambda p: F.get(a, p)), "\n"
                ).alias("t"),
            )
        ),
    )
    dropped = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop"))
    out = out.withColumn("__out", pieces)
    return out.select(
        *[F.col(f"`{c}`") for c in own],
        F.col("__out.t").alias(text_col),
        F.col("__out.n").cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    ).select(*docs.drop("n_lines", "n_dropped").columns, "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_KEY = rf"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"

#: Lines with their keys, and what is kept, for a table ``documents_in``; the pipeline's SQL uses it too.
SQL_STEPS = f"""
dl_split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents_in),
dl_keys AS (SELECT doc_id, pos, line, {_KEY} AS key FROM dl_split),
dl_held AS (SELECT key, min(doc_id) AS first_id FROM dl_keys WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
dl_out AS (SELECT k.doc_id, count(*) AS n_lines,
                  count(*) FILTER (WHERE h.key IS NOT NULL AND h.first_id <> k.doc_id) AS n_dropped,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL OR h.first_id = k.doc_id), '') AS text
           FROM dl_keys k LEFT JOIN dl_held h ON k.key = h.key GROUP BY k.doc_id)
"""

SQL = f"""
WITH documents_in AS (SELECT doc_id, text FROM documents), {SQL_STEPS}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM dl_out
"""
