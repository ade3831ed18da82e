"""Token counts by way of distinct pre-tokens: pieces are counted once for each, and joined to documents' frequencies."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship, slices, written

#: Characters on whose class every library agrees; texts with others are taken apart by the vocabulary's own library.
PLAIN = re.compile("[^\t-\r -~\x85\xa0-˿]")


def _class(kind: str) -> str:
    """The characters up to U+02FF of a Unicode category, for use in brackets."""
    return "".join(re.escape(c) for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == kind)


#: Pre-tokens of a byte-level vocabulary, in plain characters.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^\s{_class('L')}{_class('N')}]+|\s+(?!\S)|\s+")
#: Frequent pre-tokens at most that each task gets whole: a broadcast of bounded size, as keys have KEY_CHARS or little more.
FREQUENT = 50_000
#: Longer pre-tokens, such as rules of dashes, go by a digest.
KEY_CHARS = 40
#: Distinct pre-tokens, and characters of text, that a task holds before it passes their counts on.
HELD = 50_000
HELD_CHARS = 32 << 20


def pre_tokens(text: str, special: re.Pattern | None, vocabulary: str) -> list[str]:
    """What the library's tokens never cross: strings for special tokens, which it takes out first, and between them
    the pre-tokens."""
    if special is not None and "<" in text and special.search(text):
        return [x for i, part in enumerate(special.split(text)) for x in ([part] if i % 2 else pre_tokens(part, None, vocabulary))]
    if PLAIN.search(text):
        return [text[i:j] for _, (i, j) in load(vocabulary).pre_tokenizer.pre_tokenize_str(text)]
    return PRE_TOKEN.findall(text)


def key(token: str) -> str:
    """token, or a digest where it is long; a digest has more than KEY_CHARS characters, so the two never meet."""
    return token if len(token) <= KEY_CHARS else "\0" * (KEY_CHARS - 31) + xxhash.xxh3_128_hexdigest(token.encode())


@functools.cache
def load(path: str):
    """The tokenizer, once for each Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> re.Pattern | None:
    """The strings of a vocabulary's special tokens, as one group. Found on the driver, so that tasks which don't encode
    need no tokenizer."""
    added = load(path).get_added_tokens_decoder().values()
    if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added):
        raise ValueError("special tokens that depend on what stands around them aren't supported")
    strings = sorted((re.escape(x.content) for x in added), key=len, reverse=True)
    return re.compile(f"({'|'.join(strings)})") if strings else None


def distinct_pieces(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(key, freq, pieces): each distinct pre-token of all texts by its key, how often it occurs, and of how many pieces
    it consists. Tasks add up what they hold before the shuffle."""
    ship(docs.sparkSession)
    special = special_strings(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(seen)
            for i in range(0, len(keys), 50_000):
                some = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[k] for k in some], pa.int64())], names=["token", "freq"])
            seen.clear()

        chars = 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(pre_tokens(text, special, vocabulary))
                    chars += len(text)
                    if len(seen) > HELD or chars > HELD_CHARS:
                        yield from out()
                        chars = 0
        yield from out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for b in slices(batches, 2000):
            tokens = b.column(0).to_pylist()
            n = [len(x.ids) for x in tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array(map(key, tokens), pa.string()), b.column(1), pa.array(n, pa.int64())], names=["key", "freq", "pieces"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    each = texts.mapInArrow(count, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    return each.mapInArrow(pieces, "key string, freq long, pieces long")


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row: UTF-8 bytes of its whole text, and tokens as the vocabulary's library
    counts them, without begin or end. Null texts count as empty: 0 and 0.

    Pieces are counted once for each distinct pre-token and written down. The most frequent ones, FREQUENT at most, go
    to every task and join a document's frequencies there; the frequencies of all others are joined by a shuffle, in which no
    key is hot since the hot ones are the frequent ones, whatever their length or script. Repeated rows and ids stay separate rows; other columns are
    ignored.
    """
    spark, special = docs.sparkSession, special_strings(vocabulary)
    known = written(distinct_pieces(docs, vocabulary, text_col), "pieces")
    banded = known.withColumn("band", F.floor(8 * F.log2("freq")).cast("int"))
    least = _least_band([(r[0], r[1]) for r in banded.groupBy("band").count().collect()])  # 8 bands for each power of two
    send = spark.sparkContext.broadcast({r[0]: r[1] for r in banded.where(F.col("band") >= least).select("key", "pieces").toLocalIterator()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = send.value
        for b in slices(batches):
            size, total, keys, freqs, lens = [], [], [], [], []
            for text in b.column(1).to_pylist():
                n, rest = 0, 0
                for token, freq in Counter(pre_tokens(text, special, vocabulary)).items() if text else ():
                    if (p := frequent.get(token)) is None and len(token) > KEY_CHARS:
                        token = key(token)
                        p = frequent.get(token)
                    if p is not None:
                        n += p * freq
                    else:
                        keys.append(token)
                        freqs.append(freq)
                        rest += 1
                size.append(len(text.encode()) if text else 0)
                total.append(n)
                lens.append(rest)
            offsets = pa.array([0, *_sums(lens)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(freqs, pa.int64())], names=["key", "freq"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(total, pa.int64()), lists], names=["id", "row", "n_bytes", "n", "rest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = T.StructType([rows.schema["id"], *T.StructType.fromDDL("row long, n_bytes long, n long, rest array<struct<key string, freq long>>").fields])
    part = written(rows.mapInArrow(join, kinds), "parts")
    send.unpersist()
    rest = part.select("row", F.explode("rest").alias("x")).select("row", "x.key", "x.freq").join(known.select("key", "pieces"), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    return part.select("row", "id", "n_bytes", "n").join(rest, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def _least_band(bands: list[tuple[int, int]]) -> int:
    """The band of frequency from which on there are FREQUENT pre-tokens at most."""
    n, least = 0, max((b for b, _ in bands), default=0) + 1
    for band, count in sorted(bands, reverse=True):
        n += count
        if n > FREQUENT:
            break
        least = band
    return least


def _sums(lens: list[int]) -> Iterator[int]:
    n = 0
    for x in lens:
        n += x
        yield n
