"""Document chunks and their retrieval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
CHUNK_CHARS = 1800
HARD_CHARS = 2 * CHUNK_CHARS
HEADING = r"(?m)^## "
HIGH_CONFIDENCE = 0.45
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# ----------------------------------------------------------------------------------------------

_CHUNK = "struct<title:string,text:string>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chunks(docs: DataFrame, doc_id: str = "doc_id", body: str = "text", stem: str = "title") -> DataFrame:
    """Heading sections merged up to the chunk size, longer sections cut hard.

    The whole text is used.  A document is one row, so this is a fold inside the row: no
    shuffle, and documents spread over tasks as the scan splits them.
    """
    name = F.coalesce(F.col(stem).cast("string"), F.lit(""))
    parts = F.split(F.col(body), HEADING)
    first_line = lambda p: _strip(F.regexp_extract(p, r"^([^\r\n]*)", 1))
    sections = F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, p).otherwise(F.concat(F.lit("## "), p)).alias("seg"),
        F.when(i == 0, name).otherwise(first_line(p)).alias("title")))

    def entry(title: Column, text: Column) -> Column:
        return F.struct(F.coalesce(F.nullif(title, F.lit("")), name).alias("title"), text.alias("text"))

    def state(out: Column, buf: Column, title: Column) -> Column:
        return F.struct(out.alias("out"), buf.alias("buf"), title.alias("title"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["buf"]) + F.length(x["seg"]) <= CHUNK_CHARS
        kept = F.when(~fits & (_strip(s["buf"]) != ""), F.array(entry(s["title"], _strip(s["buf"])))).otherwise(
            F.array().cast(f"array<{_CHUNK}>"))
        buf = F.when(fits, F.concat(s["buf"], F.when(s["buf"] != "", "\n").otherwise(""), x["seg"])).otherwise(x["seg"])
        title = F.when(fits, F.coalesce(F.nullif(s["title"], F.lit("")), x["title"])).otherwise(x["title"])
        cuts = F.greatest(F.ceil(F.length(buf) / HARD_CHARS).cast("int") - 1, F.lit(0))
        hard = F.transform(F.filter(F.sequence(F.lit(0), cuts), lambda k: k < cuts),
                           lambda k: entry(title, F.substring(buf, k * HARD_CHARS + 1, F.lit(HARD_CHARS))))
        rest = F.substring(buf, cuts * HARD_CHARS + 1, F.lit(HARD_CHARS))
        return state(F.concat(s["out"], kept, hard), rest, title)

    start = state(F.array().cast(f"array<{_CHUNK}>"), F.lit(""), F.lit("").cast("string"))
    done = F.aggregate(sections, start, step)
    tail = F.when(_strip(F.col("_d.buf")) != "", F.array(entry(F.col("_d.title"), _strip(F.col("_d.buf"))))).otherwise(
        F.array().cast(f"array<{_CHUNK}>"))
    rows = docs.withColumn("_d", done).select(doc_id, F.posexplode(F.concat("_d.out", tail)).alias("chunk", "c"))
    return rows.select(doc_id, "chunk", "c.title", "c.text")


def _add(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in double precision; a zero vector is similar to nothing."""
    dot = _add(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = lambda v: F.sqrt(_add(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(dot, size(a) * size(b))


def _top(scored: DataFrame, item: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), F.col(item))
    return (scored.filter("raw > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(k))
            .withColumn("score", F.round("raw", 4)).drop("raw"))


def vector_search(items: DataFrame, queries: Mapping[str, Sequence[float]], item: str, vector: str, k: int = 5) -> DataFrame:
    """The k most similar items per query vector.

    Query vectors are parameters, so every item is scored where it is scanned; only each
    task's best k per query leave it.
    """
    q = F.array(*[F.struct(F.lit(name).alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("q"))
                  for name, v in queries.items()])
    scored = items.select(item, vector, F.inline(q)).withColumn("raw", cosine(F.col(vector), F.col("q")))
    return _top(scored.select("query_id", item, "raw"), item, k)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != ""))


def keyword_search(items: DataFrame, queries: Mapping[str, str], item: str, body: str, k: int = 5) -> DataFrame:
    """The k items holding the largest share of a query's distinct words."""
    asked = F.array(*[F.struct(F.lit(name).alias("query_id"), F.lit(q).alias("q")) for name, q in queries.items()])
    rows = items.withColumn("_t", tokens(F.col(body))).select(item, "_t", F.inline(asked)).withColumn("_q", tokens(F.col("q")))
    scored = rows.withColumn("raw", F.try_divide(F.size(F.array_intersect("_t", "_q")), F.size("_q")))
    return _top(scored.select("query_id", item, "raw"), item, k)


def search_company_knowledge(hits: DataFrame) -> DataFrame:
    """answer confidence per query from its hits; no hit is low."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best")).withColumn(
        "confidence", F.when(F.col("best") >= HIGH_CONFIDENCE, "High").otherwise("Medium"))
