"""Benchmark decontamination with a distributed positional inverted index.

Postings (term, row_key, position) are stored once for the terms that the
benchmark uses, and read for their counts and for their lists.  Every benchmark window is looked up from its rarest terms: their
postings, shifted by the term's offset, meet at the start of a possible match;
starts that all of them share are verified against the whole phrase.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed, written
from .url_rules import LOWER, UPPER

#: Look-up tables made from the benchmark are broadcast up to this many rows, and joined by a shuffle beyond it.
BROADCAST_ROWS = 100_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII digits, letters (lower-cased) and all non-ASCII characters; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAPS), "")


def near(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` counted rows, broadcast if that is bounded."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def phrases(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows: phrase_id, phrase array<string>, n, items array<string>.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A null item_id counts as the empty string.
    """
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("phrase"))
    w = w.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return w.select(F.xxhash64("phrase").alias("phrase_id"), "phrase", F.size("phrase").alias("n"), "items")


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The positional index of ``terms`` (column term), stored: term, row_key, pos (from 0)."""
    every = docs.select("row_key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return written(every.join(near(terms.select("term"), n_terms), "term").select("term", "row_key", "pos"))


def phrase_candidates(docs: DataFrame, windows: DataFrame, rarest: int = 2) -> DataFrame:
    """row_key, phrase_id, start where the ``rarest`` rarest terms of a window stand at their offsets."""
    terms = windows.select("phrase_id", F.posexplode("phrase").alias("offset", "term"))
    vocabulary = written(terms.select("term").distinct())
    index = postings(docs, vocabulary, vocabulary.count())
    counts = index.groupBy("term").count()
    ranked = Window.partitionBy("phrase_id").orderBy("c", "offset")
    probes = terms.join(counts, "term", "left").withColumn("c", F.coalesce("count", F.lit(0))).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= rarest)
    # a window with a term that no document has cannot occur
    probes = probes.withColumn("need", F.count("*").over(Window.partitionBy("phrase_id"))).withColumn("least", F.min("c").over(Window.partitionBy("phrase_id"))).where("least > 0")
    probes = written(probes.select("term", "phrase_id", "offset", "need"))
    lists = index.join(near(probes, probes.count()), "term")
    met = lists.where("pos >= offset").groupBy("row_key", "phrase_id", (F.col("pos") - F.col("offset")).alias("start"), "need").agg(F.countDistinct("offset").alias("have") if rarest > 2 else F.count("*").alias("have"))
    return met.where("have >= need").select("row_key", "phrase_id", "start")


def phrase_matches(documents: DataFrame, benchmark: DataFrame, size: int = 10, rarest: int = 2, carry: Column | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, spans array<struct<start, n>>, items array<string>.

    ``spans`` are the exact occurrences of benchmark windows (word positions from
    0), ``items`` the sorted ids of the items they come from.  Null and empty
    texts have no words; a row with a null doc_id is judged like any other; rows
    that repeat doc_id and text are returned as often as they come.  Without
    benchmark words nothing is hit.  Other columns are not read, but ``carry`` is
    returned as it is, with the text.
    """
    docs = keyed(documents, (F.lit(None).cast("string") if carry is None else carry).alias("carry"))
    windows = written(phrases(benchmark, size))
    found = phrase_candidates(docs.select("row_key", "text"), windows, rarest)
    found = found.dropDuplicates(["row_key", "phrase_id", "start"]).join(near(windows, windows.count()), "phrase_id")
    # places, and each phrase once however often it occurs
    per_doc = found.groupBy("row_key").agg(
        F.collect_list(F.struct("start", "n", "phrase_id")).alias("c"),
        F.map_from_entries(F.collect_set(F.struct("phrase_id", F.struct("phrase", "items")))).alias("p"),
    )
    all_words = docs.join(per_doc, "row_key", "left").select("doc_id", "carry", "text", words(F.col("text")).alias("w"), "c", "p")
    none = F.expr("cast(array() as array<struct<start:int,n:int,phrase_id:bigint>>)")
    real = F.filter(F.coalesce("c", none), lambda x: F.slice("w", x["start"] + 1, x["n"]) == F.col("p")[x["phrase_id"]]["phrase"])
    made = all_words.select("doc_id", "carry", "text", F.size("w").cast("long").alias("n_words"), real.alias("c"), "p").select(
        "doc_id", "carry", "text", "n_words",
        F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.col("c.phrase_id")), lambda i: F.col("p")[i]["items"])))).alias("items"),
    )
    return made.drop("carry", "text") if carry is None else made


def proximity_matches(documents: DataFrame, terms: DataFrame, within: int = 10) -> DataFrame:
    """query_id, row_key, start, end: places where all terms of a query stand within ``within`` words.

    ``terms`` has query_id and term (a lower-cased word).  One match is given for
    each position of the query's rarest term that lies in such a place: the
    shortest such place around it, the earliest of equally short ones; nulls are
    ignored.
    """
    t = written(terms.where("query_id is not null and term is not null").select("query_id", "term").distinct())
    n = t.count()
    index = postings(keyed(documents), t.select("term").distinct(), n)
    counts = index.groupBy("term").count()
    ranked = t.join(counts, "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("count", F.lit(0)), "term"))).withColumn("need", F.count("*").over(Window.partitionBy("query_id")))
    first = index.join(near(ranked.where("r = 1").select("query_id", "term", "need"), n), "term").select("query_id", "need", "row_key", F.col("pos").alias("p"))
    rest = index.join(near(ranked.where("r > 1").select("query_id", "term"), n), "term").select("query_id", "row_key", F.col("term").alias("t"), F.col("pos").alias("q"))
    # equi-join on blocks of positions, so a frequent term in a long document stays bounded
    block = lambda c: F.floor(F.col(c) / within)
    far = rest.withColumn("b", F.explode(F.array(block("q") - 1, block("q"), block("q") + 1)))
    pairs = first.withColumn("b", block("p")).join(far, ["query_id", "row_key", "b"], "left").where(F.col("q").isNull() | (F.abs(F.col("q") - F.col("p")) < within))
    # a position holds one word, so an anchor has fewer than 2 * within candidates
    candidate = F.when(F.col("q").isNotNull(), F.struct("q", "t"))
    near_by = pairs.groupBy("query_id", "need", "row_key", "p").agg(F.collect_set(candidate).alias("c")).withColumn("ts", F.array_distinct("c.t")).where("size(ts) = need - 1")
    # from every start at or before the anchor, the first position of each other term; null where a term is missing
    starts = F.array_distinct(F.concat(F.array("p"), F.filter("c.q", lambda q: q < F.col("p"))))
    firsts = lambda s: F.transform("ts", lambda t: F.array_min(F.filter("c", lambda x: (x["t"] == t) & (x["q"] >= s))["q"]))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), firsts(s).alias("f")))
    spans = F.transform(F.filter(spans, lambda x: ~F.exists(x["f"], lambda q: q.isNull())), lambda x: F.struct(x["start"].alias("start"), F.greatest(F.coalesce(F.array_max(x["f"]), F.col("p")), F.col("p")).alias("end")))
    tightest = F.array_min(F.transform(spans, lambda x: F.struct((x["end"] - x["start"]).alias("d"), x["start"].alias("start"), x["end"].alias("end"))))
    whole = near_by.withColumn("m", tightest).where(F.col("m.d") < within)
    return whole.select("query_id", "row_key", "m.start", "m.end")
