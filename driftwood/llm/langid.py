"""Language identification with language-bitmask n-gram filters.

Method: a bit-sliced Bloom filter.  Each of ``slots`` cells holds one bit per language; an n-gram
of letters has ``hashes`` cells, and the AND of their words is the set of all languages whose
filter holds the n-gram.  For each text the bits are counted per language over all its n-grams.  A
language's filter also answers yes for strangers, at the rate fill**hashes; the counts are
corrected for it, and the largest corrected count decides.

A filter holds the n-grams that are frequent in its language: at least ``min_rate`` of its n-grams
and at least ``min_share`` of the rate in the language in which the n-gram is most frequent.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, small_batches, table
from ._hashing import mix, slices, tidy

UNDETERMINED = "und"
_BATCH = 1 << 17


@dataclass(frozen=True)
class Model:
    """cells: (slots, ceil(languages / 64)) words of bits; false: rate of false answers a language."""

    languages: tuple[str, ...]
    orders: tuple[int, ...]
    hashes: int
    cells: np.ndarray
    false: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter, 0 of others."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


def _grams(texts: list[str | None], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each n-gram, its text's index): runs of letters, with a blank around each."""
    low = _letters()
    raw = "\0".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, np.uint32)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    c = low[code]
    c[ends - 1] = 0
    gap = c == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # one blank after each run
    at = np.flatnonzero(keep)
    c = np.concatenate((np.zeros(1, np.uint64), c[at].astype(np.uint64)))
    doc = np.searchsorted(ends, at, side="right")
    doc = np.concatenate((doc[:1], doc))
    out, of = [], []
    for n in orders:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[j : len(c) - n + 1 + j]
        # A gram belongs to the text of its second character; those over two texts or of blanks go.
        d, e = doc[1 : len(h) + 1] if n > 1 else doc[: len(h)], doc[n - 1 :]
        inner = c[(n // 2) : (n // 2) + len(h)] != 0
        ok = (d == e) & inner
        out.append(mix(h[ok]))
        of.append(e[ok])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _BATCH or i + 1 == len(texts):
            yield a, i + 1
            a, size = i + 1, 0


def _count_batches(orders: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, 0, 4 * _BATCH)):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                parts = [np.unique(_grams(own[a:b], orders)[0], return_counts=True) for a, b in _parts(own)]
                keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": keys.view(np.int64), "n": n})

    return tidy(run)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows_per_language: int = 4000, orders: tuple[int, ...] = (3, 4), slots: int = 1 << 18, hashes: int = 2, min_rate: float = 1e-5, min_share: float = 0.3) -> Model:
    """Learn the filters from rows with a text and a language.

    The fit is on a bounded sample, about ``max_rows_per_language`` rows of each language, those
    whose hashed key is smallest; whole texts are counted.  A filter holds at most
    ``1 / min_rate`` n-grams; ``slots`` is a power of two.  Without labelled rows the model has no language and every
    prediction is ``und``.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"))
    per = rows.groupBy("lang").count().collect()  # one row a language
    languages = tuple(sorted(r["lang"] for r in per))
    if not languages:
        return Model((), orders, hashes, np.zeros((slots, 1), np.uint64), np.zeros(0))
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for r in per for x in (r["lang"], min(1.0, max_rows_per_language / r["count"]))))
    sample = rows.where(unit < share[F.col("lang")]).select("text", "lang")
    counts = durable(sample.mapInArrow(_count_batches(orders), "lang string, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*(F.lit(x) for k, v in [("", 1), *total.items()] for x in (k, float(v))))[F.col("lang")]
    by = counts.withColumn("rate", rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("l"))
    held = by.select("gram", "top", F.explode("l").alias("x")).where((F.col("x.rate") >= min_rate) & (F.col("x.rate") >= min_share * F.col("top")))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (k, i)))[F.col("x.lang")]
    bits = held.select(F.explode(F.array(*(F.shiftrightunsigned("gram", 20 * j).bitwiseAND(slots - 1) for j in range(hashes)))).alias("at"), number.alias("i"))
    bits = bits.groupBy("at", (F.col("i") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, i % 64)")).alias("bits"))
    cells = np.zeros((slots, (len(languages) + 63) // 64), np.uint64)
    for r in bits.collect():  # a row for each cell and 64 languages at most
        cells[r["at"], r["word"]] = np.uint64(r["bits"] % (1 << 64))
    false = np.array([(((cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** hashes for i in range(len(languages))])
    return Model(languages, orders, hashes, cells, false)


def _cells(grams: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    return [((grams >> np.uint64(20 * j)) & np.uint64(slots - 1)).astype(np.int64) for j in range(hashes)]


def _score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, n = model.languages, len(texts)
    best, score = np.full(n, -1), np.zeros(n)
    for a, b in _parts(texts):
        grams, of = _grams(texts[a:b], model.orders)
        total = np.bincount(of - 0, minlength=b - a).astype(float)
        if not names:
            continue
        bits = None
        for at in _cells(grams, len(model.cells), model.hashes):
            bits = model.cells[at] if bits is None else bits & model.cells[at]
        counts = np.zeros((len(names), b - a))
        for i in range(len(names)):
            hit = (bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            counts[i] = np.bincount(of, weights=hit, minlength=b - a)
        counts = np.maximum(0, (counts - total * model.false[:, None]) / (1 - np.minimum(model.false, 0.999))[:, None])
        whole = counts.sum(axis=0)
        top = counts.argmax(axis=0)
        score[a:b] = np.where(whole > 0, counts[top, np.arange(b - a)] / np.maximum(whole, 1e-300), 1 / len(names))
        best[a:b] = top
    letters = _letters()
    out, scores = [], []
    for t, i, s in zip(texts, best, score, strict=True):
        some = bool(t) and (i >= 0) and bool(letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any())
        out.append(names[i] if some else UNDETERMINED)
        scores.append(float(min(1.0, s)) if some else 0.0)
    return out, scores


def _predict_batches(model, text: str, names: tuple[str, str], keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in found:
            k = batch.schema.get_field_index(text)
            rest = [i for i in range(batch.num_columns) if keep or i != k]
            for part in slices(batch, k, 4 * _BATCH):
                pred, score = _score(m, part.column(k).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(part.schema.names[i] for i in rest), *names])

    return tidy(run)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: share of the corrected counts).

    A text that is null or has no letter gets ``und`` and 0; ties go to the first language by
    name.  The column ``text`` is dropped unless ``keep_text``; columns that have the new names
    are replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if keep_text or f.name != text), "lang_pred string, score double"])
    return src.mapInArrow(_predict_batches(sent, text, ("lang_pred", "score"), keep_text), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
