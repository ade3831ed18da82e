"""Benchmark decontamination: windows of normalised words against a broadcast table of the benchmark's windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import BROADCAST_BYTES, small, written

WINDOW = 13
#: A word after A-Z are lower-cased, and before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20


def lower_az(c: Column) -> Column:
    """c with A-Z lower-cased and all else as it is. Plain ASCII takes the quick way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(lower_az(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, len, words, items): every run of window words of an item, or all its words if it has fewer, with the ids
    (as strings) of the items that hold it. Items without words have none; a null id counts as an empty one."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    runs = items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("len")).select(
        "item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at")
    )
    runs = runs.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("words"))
    return runs.groupBy("len", "words").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64(F.transform("words", lambda x: F.xxhash64(x))).alias("key"), "len", "words", "items"
    )


def window_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: (row, id, n_words, hits array<struct<at, len, items>>): each occurrence of a
    benchmark window in the row's words, at counted from 0, found by hash and confirmed word by word.

    A row is expanded into its windows inside one stage that ends in a broadcast hash join, so only the row itself and
    its hits are shuffled. Where the benchmark's windows are too large to broadcast, see _by_shuffle. Null, empty and
    wordless texts get no hits; repeated rows and ids stay separate rows; other columns are ignored.
    """
    known = written(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    lens = sorted(r[0] for r in known.select("len").distinct().collect())  # window lengths: window of them at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    size = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("words") + F.size("items")) + 64
    return _by_broadcast(rows, known, lens, window) if small(known, size, BROADCAST_BYTES) else _by_shuffle(rows, known, lens)


def _spots(rows: DataFrame, lens: list[int], least: int) -> DataFrame:
    """rows (with n_words) and each place at (from least on, -1 standing for no place) and length d_len of a window.
    Outer, as else the optimizer would take the words apart once more to see whether there are any."""
    if len(lens) == 1:
        spots = rows.select("*", F.explode_outer(F.sequence(F.lit(least), F.greatest(F.lit(least), F.col("n_words") - lens[0]))).alias("at")).withColumn("d_len", F.lit(lens[0]))
    else:
        spots = rows.select("*", F.explode_outer(F.sequence(F.lit(least), F.greatest(F.lit(least), F.col("n_words") * len(lens) - 1))).alias("k"))
        spots = spots.withColumn("d_len", F.when(F.col("k") < 0, 0).otherwise(F.get(F.array(*map(F.lit, lens)), F.pmod("k", F.lit(len(lens)))))).withColumn("at", F.floor(F.col("k") / len(lens)).cast("int"))
    return spots.where("at < 0 or at + d_len <= n_words")


def _by_broadcast(rows: DataFrame, known: DataFrame, lens: list[int], window: int) -> DataFrame:
    # one more window of length 0 stands for the row itself
    itself = known.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("len"), F.expr("cast(array() as array<string>)").alias("words"), F.expr("cast(array() as array<string>)").alias("items"))
    rows = rows.select("row", "id", "w", F.size("w").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    spots = _spots(rows, lens or [window], -1)
    spots = spots.withColumn("key", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.slice("h", F.col("at") + 1, F.col("d_len")))))
    same = F.when(F.col("at") < 0, F.col("len") == 0).otherwise((F.col("len") == F.col("d_len")) & (F.slice("w", F.col("at") + 1, F.col("d_len")) == F.col("words")))
    met = spots.join(F.broadcast(known.unionByName(itself)), "key").where(same).select("row", "id", "n_words", F.when(F.col("at") >= 0, F.struct("at", "len", "items")).alias("hit"))
    return met.groupBy("row", "id", "n_words").agg(F.collect_list("hit").alias("hits"))


def _by_shuffle(rows: DataFrame, known: DataFrame, lens: list[int]) -> DataFrame:
    """As _by_broadcast, with windows shuffled as row, place and hash alone; the words of rows with a hit are met once
    more, and only their windows confirmed."""
    rows = written(rows.withColumn("n_words", F.size("w")), "words")
    spots = _spots(rows.select("row", "n_words", F.transform("w", lambda x: F.xxhash64(x)).alias("h")), lens, 0)
    spots = spots.select("row", "at", "d_len", F.xxhash64(F.slice("h", F.col("at") + 1, F.col("d_len"))).alias("key"))
    met = spots.join(known.select("key", F.col("len").alias("d_len")), ["key", "d_len"], "left_semi")
    found = rows.join(met.groupBy("row").agg(F.collect_list(F.struct("at", "d_len", "key")).alias("x")), "row").select("row", "w", F.explode("x").alias("x"))
    said = found.select("row", "x.at", "x.key", F.slice("w", F.col("x.at") + 1, F.col("x.d_len")).alias("words"))
    hits = said.join(known, ["key", "words"]).groupBy("row").agg(F.collect_list(F.struct("at", "len", "items")).alias("hits"))
    none = F.expr("cast(array() as array<struct<at: int, len: int, items: array<string>>>)")
    return rows.select("row", "id", "n_words").join(hits, "row", "left").select("row", "id", "n_words", F.coalesce("hits", none).alias("hits"))


def _covered(hits: Column) -> Column:
    """Words in the union of the hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(x: Column, h: Column) -> Column:
        end = F.greatest(x["end"], h["at"] + h["len"])
        return F.struct(end.alias("end"), (x["n"] + end - F.greatest(x["end"], F.least(end, h["at"]))).alias("n"))

    return F.aggregate(F.array_sort(F.transform(hits, lambda h: F.struct(h["at"].alias("at"), h["len"].alias("len")))), start, step, lambda x: x["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", share: int = SHARE, **how) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, contaminated) for every row of docs; see window_hits. n_hit counts
    the words inside any hit; contaminated: n_hit > 0 and share * n_hit >= n_words."""
    found = window_hits(docs, benchmark, id_col, **how).select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), _covered(F.col("hits")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __key: what a row is known by, its id and the digest of its text, so that rows of one id are judged
    each for itself."""
    return docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("t")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated ones, all columns kept. Rows are judged each by its own text, those that share an
    id too; repeated rows stay or go together, and rows without an id stay."""
    keyed = _keyed(docs, id_col, text_col)
    bad = contamination(keyed, benchmark, "__key", text_col=text_col, **how).where("contaminated").select(F.col("__key.id").alias("__bad"), F.col("__key.t").alias("__text")).distinct()
    return keyed.join(bad, (F.col(id_col) == F.col("__bad")) & (F.col("__key.t") == F.col("__text")), "left_anti").select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with hit words, and what stands between them and the next word, cut from text_col; all columns and rows
    stay, repeated ones too, and each text of an id is cut for itself. Rows with a null id or no hit keep their text."""
    keyed = _keyed(docs, id_col, text_col)
    hits = window_hits(keyed, benchmark, "__key", text_col, **how).where("size(hits) > 0")
    spans = hits.select(F.col("id.id").alias("__id"), F.col("id.t").alias("__text"), F.transform("hits", lambda h: F.struct(h["at"].alias("a"), (h["at"] + h["len"]).alias("z"))).alias("__spans"))
    spans = spans.dropDuplicates(["__id", "__text"])  # equal texts have the same
    lead = F.regexp_extract(text_col, "^(?s:.*?)(?=" + WORD_ANY_CASE + "|$)", 0)
    parts = F.regexp_extract_all(F.col(text_col), F.lit("(" + WORD_ANY_CASE + r")([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(0))
    left = F.filter(parts, lambda x, i: ~F.exists("__spans", lambda s: (i >= s["a"]) & (i < s["z"])))
    cut = keyed.join(spans, (F.col(id_col) == F.col("__id")) & (F.col("__key.t") == F.col("__text")), "left")
    return cut.withColumn(text_col, F.when(F.col("__spans").isNotNull(), F.concat(lead, F.array_join(left, ""))).otherwise(F.col(text_col))).select(docs.columns)
