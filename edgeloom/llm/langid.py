"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship, slices, written

#: Languages that are learnt: the most frequent ones.
LANGUAGES = 100
#: Labelled rows of each language that the regression is fitted on, and those of them that serve as landmarks; landmarks altogether.
TRAIN_ROWS = 300
LANDMARKS = 48
ALL_LANDMARKS = 768
#: Longest n-grams (characters) of the kernel.
ORDER = 3
#: Characters of all landmarks together: one that would have more than its share stands for a stretch from the middle
#: of its text. It bounds the model; training rows and the texts to be told apart count whole.
LANDMARK_CHARS = 1 << 21
#: N-grams that are multiplied at a time.
GRAMS = 8192
RIDGE = 1e-2
#: Steepness of the softmax that turns margins into scores.
SHARPNESS = 8.0
#: Rows that are scored by one matrix product.
BLOCK = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def spectrum(text: str, order: int = ORDER) -> np.ndarray:
    """The different n-grams, 1 to order characters, of the lower-cased text, as numbers that say which they are, sorted."""
    step = 1 << 18  # code points at a time, overlapping; all of the text counts
    text, found = text.lower(), [np.zeros(0, np.uint64)]
    for i in range(0, len(text), step):
        c = np.frombuffer(text[i : i + step + order - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        code, parts = c, [c]
        for n in range(1, min(order, len(c))):
            code = (code[:-1] << np.uint64(21)) | c[n:]
            parts.append(code)
        found.append(np.unique(np.concatenate(parts)))
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


@dataclass
class Landmarks:
    """grams: all n-grams of the landmarks, sorted; held: for each of them a bit for each landmark that has it; sizes: how many
    n-grams each landmark has."""

    grams: np.ndarray
    held: np.ndarray
    sizes: np.ndarray

    def kernel(self, spectra: Iterator[np.ndarray]) -> np.ndarray:
        """Presence kernel of each spectrum with each landmark: what they share, over the root of both sizes. The shared
        n-grams are counted by products of matrices, GRAMS columns at a time; n-grams that no landmark has count in the
        size alone, so that nothing is merged and no text is too long."""
        sizes, rows, places = [], [], []
        for i, x in enumerate(spectra):
            at = np.searchsorted(self.grams, x)
            at[at == len(self.grams)] = 0
            hit = at[self.grams[at] == x] if len(self.grams) else at[:0]
            sizes.append(len(x))
            rows.append(np.full(len(hit), i))
            places.append(hit)
        out = np.zeros((len(sizes), len(self.sizes)), np.float64)
        if not len(self.grams) or not sizes:
            return out
        row, place = np.concatenate(rows), np.concatenate(places)
        used, column = np.unique(place, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, len(used), GRAMS):
            part = slice(*np.searchsorted(column, [at, at + GRAMS]))
            x = np.zeros((len(sizes), min(GRAMS, len(used) - at)), np.float32)
            x[row[part], column[part] - at] = 1
            out += x @ np.unpackbits(self.held[used[at : at + GRAMS]], axis=1, count=len(self.sizes)).astype(np.float32)
        return out / np.sqrt(np.maximum(np.array(sizes), 1))[:, None] / np.sqrt(self.sizes)[None, :]


def landmarks(spectra: list[np.ndarray]) -> Landmarks:
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *spectra]))
    held = np.zeros((len(grams), (len(spectra) + 7) // 8), np.uint8)
    for i, x in enumerate(spectra):
        held[np.searchsorted(grams, x), i // 8] |= 128 >> i % 8
    return Landmarks(grams, held, np.maximum(np.array([len(x) for x in spectra], np.float64), 1))


@dataclass
class Model:
    """languages; marks: the landmarks; weights: from kernel values with the landmarks, and one, to a margin for each
    language."""

    languages: list[str]
    marks: Landmarks
    weights: np.ndarray
    order: int = ORDER

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1 of each text; UNKNOWN and 0 where there is no letter to go by."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return lang, score
        for at in range(0, len(texts), BLOCK):
            some = [i for i in range(at, min(at + BLOCK, len(texts))) if texts[i] and LETTER.search(texts[i])]
            if not some:
                continue
            m = self.marks.kernel(spectrum(texts[i], self.order) for i in some) @ self.weights[:-1] + self.weights[-1]
            e = np.exp(SHARPNESS * (m - m.max(axis=1, keepdims=True)))
            best = m.argmax(axis=1)
            score[some] = (e / e.sum(axis=1, keepdims=True))[np.arange(len(some)), best]
            for i, b in zip(some, best, strict=True):
                lang[i] = self.languages[b]
        return lang, score


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, n, text): of each of the LANGUAGES most frequent languages TRAIN_ROWS different labelled rows at most, none
    of them held out, n from 1.

    Rows are taken by a hash of id and text, so that repeated rows count once. A first pass counts each language's
    hashes; a second one lets only hashes below a threshold through, twice TRAIN_ROWS of a language as expected, and
    only those are ranked: neither a language with most rows nor a row with many copies gathers anywhere."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("c")).orderBy(F.desc("c"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(2.0 * TRAIN_ROWS) / F.col("c"))
    counts = F.broadcast(written(counts.select(F.col("lang"), share.alias("share")), "languages"))
    place = (F.col("h") / F.lit(2.0**64)) + F.lit(0.5)  # from 0 to 1
    some = known.join(counts, "lang").where(place <= F.col("share")).dropDuplicates(["lang", "h"])
    return some.selectExpr("lang", "row_number() over (partition by lang order by h) as n", "text").where(F.col("n") <= TRAIN_ROWS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model:
    """The model of the languages in lang_col, from training_rows. The landmarks, LANDMARK_CHARS characters at most, come
    to the driver; of every training row, however long, its kernel values with the landmarks do, LANGUAGES * TRAIN_ROWS
    * ALL_LANDMARKS numbers at most. Without labelled rows the model knows no language."""
    if not 1 <= order <= 3:
        raise ValueError("n-grams have one to three characters")
    spark = docs.sparkSession
    ship(spark)
    rows = written(training_rows(docs, id_col, text_col, lang_col).where("text <> ''"), "training")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # LANGUAGES at most
    if not languages:
        return Model([], landmarks([]), np.zeros((1, 0)), order)
    each = max(2, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    chars = max(order, LANDMARK_CHARS // (each * len(languages)))
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2).cast("int") + 1), F.lit(chars))
    first = Window.partitionBy("lang").orderBy("n")
    chosen = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).select("lang", "n", middle.alias("text")).orderBy("lang", "n").collect()
    marks = landmarks([spectrum(r.text, order) for r in chosen])
    send = spark.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCK):
            k = send.value.kernel(spectrum(x, order) for x in b.column(2).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in k], pa.binary())], names=["lang", "n", "k"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["lang"], rows.schema["n"], T.StructField("k", T.BinaryType())])).collect()
    return train(sorted((r["lang"], r["n"], r["k"]) for r in found), marks, marks.kernel(spectrum(r.text, order) for r in chosen), order)


def train(rows: list[tuple[str, int, bytes]], marks: Landmarks, own: np.ndarray, order: int = ORDER) -> Model:
    """The model from (language, number within it, kernel values with the landmarks) and the landmarks' own kernel
    values: kernel ridge regression on Nyström features, each language against the rest, with the same weight for every
    language."""
    languages = sorted({r[0] for r in rows})
    of = {x: sum(r[0] == x for r in rows) for x in languages}
    k_nm = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([k_nm @ root, np.ones((len(rows), 1))])
    y = np.array([[1.0 if r[0] == x else -1.0 for x in languages] for r in rows])
    weight = np.array([len(rows) / len(languages) / of[r[0]] for r in rows])[:, None]
    ridge = RIDGE * len(rows) * np.eye(phi.shape[1])
    ridge[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ (weight * phi) + ridge, phi.T @ (weight * y))
    return Model(languages, marks, np.vstack([root @ beta[:-1], beta[-1:]]), order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, lang_pred, score) for every row, or with keep all columns of docs and these two, from its whole text alone.

    Null texts and those without a letter are UNKNOWN with score 0, and so is everything if the model knows no
    language. The model is a broadcast whose size LANDMARK_CHARS and ALL_LANDMARKS bound. Repeated rows stay repeated."""
    ship(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast((model.languages, model.marks, model.weights, model.order))
    rows = docs if keep else docs.select(id_col, text_col)
    out = [x for x in rows.columns if keep or x == id_col]
    at = rows.columns.index(text_col)
    names = [*out, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*send.value)
        for b in slices(batches, BLOCK):
            lang, score = own.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(rows_at[x]) for x in out), pa.array(lang, pa.string()), pa.array(score)], names=names)

    rows_at = {x: i for i, x in enumerate(rows.columns)}
    return rows.mapInArrow(run, T.StructType([*(rows.schema[x] for x in out), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language can't be told (UNKNOWN); columns as they are. A model that knows no language
    rejects only texts that are null or without a letter."""
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    clash = {x: f"__{i}" for i, x in enumerate(docs.columns) if x in ("lang_pred", "score")}
    safe = docs.withColumnsRenamed(clash)
    found = identify(safe, model, text_col=text_col, keep=True)
    return found.where(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in clash.items()})
