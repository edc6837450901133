"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one
window). Its shingles are ordered by how rarely the corpus has them; a document can
only hold the window where it holds the rarest one, its prefix. Prefix matches that
pass the positional and length bounds are verified shingle by shingle. Column
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.words import document_key, let, word_array
from textbench.session import materialize

WINDOW = 10
SHINGLE = 3
#: Bytes of benchmark rows that travel to every task; a larger benchmark is joined by a shuffle.
BROADCAST_BYTES = 256 * 2**20
#: What a row takes besides its strings.
ROW_BYTES = 64


def _runs(words: Column, most: int) -> Column:
    """All runs of ``most`` consecutive words (of all words, if there are fewer), as
    strings, in order; none of no words."""

    def of(words: Column) -> Column:
        width = F.least(F.size(words), F.lit(most))
        starts = F.sequence(F.lit(1), F.size(words) - width + 1)
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, width), " "))
        return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window): the distinct windows of each item; items without words have none."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return words.select("item_id", F.explode(_runs(F.col("words"), window)).alias("window")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, n, parts, at, shingle): each window's shingles with their places."""
    words = F.split("window", " ")
    out = windows.select("window").distinct().select("window", F.size(words).alias("n"), words.alias("words"))
    out = out.select("window", "n", _runs(F.col("words"), shingle).alias("runs"))
    return out.select("window", "n", F.size("runs").alias("parts"), F.posexplode("runs").alias("at", "shingle"))


def small(df: DataFrame, size: int, most: int) -> DataFrame:
    """A hint to send ``df`` to every task, if its bytes were counted to be few."""
    return F.broadcast(df) if size <= most else df


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, text_hash, start, n, window): every place where a document has a window.

    Rows of equal id and text count as one document here. NULL and empty texts, an
    empty benchmark and items without words match nothing. Neither side is collected.
    """
    parts = materialize(window_shingles(item_windows(benchmark, window), shingle))
    size = parts.agg(F.sum(F.octet_length("window") + F.octet_length("shingle") + F.lit(ROW_BYTES))).first()[0] or 0
    widths = [r["w"] for r in parts.select(F.least("n", F.lit(shingle)).alias("w")).distinct().collect()]
    vocabulary = small(parts.select("shingle").distinct(), size, broadcast_bytes)

    words = documents.select(*document_key(), word_array(F.col("text")).alias("words"))
    matches = None
    for width in sorted(widths) or [shingle]:  # as many as the shortest items need, 3 at most
        runs = F.posexplode(_runs(F.col("words"), width)).alias("place", "shingle")
        found = words.select("doc_id", "text_hash", F.size("words").alias("n_words"), runs).join(vocabulary, "shingle")
        matches = found if matches is None else matches.unionByName(found)
    matches = materialize(matches)

    counts = matches.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"))
    ranked = parts.join(counts, "shingle", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    prefix = ranked.groupBy("window").agg(
        F.min(F.struct("rows", "shingle", "at")).alias("rarest"), F.first("n").alias("n"), F.first("parts").alias("parts")
    )
    prefix = prefix.filter("rarest.rows > 0").select(
        "window", "n", "parts", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("at")
    )
    start = F.col("place") - F.col("at")
    candidates = (
        matches.join(small(prefix, size, broadcast_bytes), "shingle")
        .withColumn("start", start)
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
        .select("doc_id", "text_hash", "start", "n", "parts", "window")
    )
    wanted = small(parts.select("window", "at", "shingle"), size, broadcast_bytes)
    asked = candidates.join(wanted, "window").withColumn("place", F.col("start") + F.col("at"))
    a, b = asked.alias("a"), matches.alias("b")
    same = (
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("a.text_hash") == F.col("b.text_hash"))
        & (F.col("a.place") == F.col("b.place"))
        & (F.col("a.shingle") == F.col("b.shingle"))
    )
    verified = a.join(b, same).groupBy("a.doc_id", "a.text_hash", "a.start", "a.n", "a.parts", "a.window")
    verified = verified.agg(F.size(F.collect_set("a.at")).alias("seen")).filter("seen = parts")
    return verified.select("doc_id", "text_hash", "start", "n", "window")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Per row of ``documents``: doc_id, text_hash, n_words, n_hit, items, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` holds the
    sorted ids of the items with occurring windows. Repeated rows stay; rows without
    an id keep a NULL id; very long texts are read whole; other columns of either table are
    ignored; an empty table gives no rows.
    """
    places = overlaps(documents, benchmark, **settings)
    key = ["doc_id", "text_hash"]
    spans = places.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans")
    )
    none = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))
    n_hit = F.aggregate(
        "spans",
        none,
        lambda a, x: F.struct(
            (a["covered"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("covered"),
            F.greatest(a["reach"], x["end"]).alias("reach"),
        ),
        lambda a: a["covered"],
    )
    windows = item_windows(benchmark, settings.get("window", WINDOW))
    named = places.select(*key, "window").distinct().join(windows, "window")
    items = named.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    spans, items = spans.select(*key, n_hit.alias("n_hit")), items.alias("i")
    found = spans.join(items, both(spans, items), "left").select(spans["doc_id"], spans["text_hash"], "n_hit", "items")
    docs = documents.select(*document_key(), F.size(word_array(F.col("text"))).cast("bigint").alias("n_words"))
    out = docs.join(found, both(docs, found), "left")
    return out.select(
        docs["doc_id"],
        docs["text_hash"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``documents`` without those that hold any window of the benchmark, columns unchanged;
    an empty table stays empty."""
    found = overlaps(documents, benchmark, **settings).select("doc_id", "text_hash").distinct()
    rows = documents.select(
        documents["doc_id"].alias("row_id"),
        F.xxhash64(F.coalesce(documents["text"], F.lit(""))).alias("row_hash"),
        F.struct(*(documents[c] for c in documents.columns)).alias("row"),
    )
    same = F.col("row_id").eqNullSafe(found["doc_id"]) & (F.col("row_hash") == found["text_hash"])
    return rows.join(found.hint("merge"), same, "left_anti").select(*(F.col("row")[c].alias(c) for c in documents.columns))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    tables = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return decontaminate(*tables).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0))
),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
