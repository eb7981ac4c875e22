"""Byte-level BPE encoding and decoding.

Method: overlapping chunk encoding.  A text of up to ``chunk_chars`` code points is one piece.  A
longer one is cut into chunks that overlap; each chunk is pre-tokenised by a task of its own, from
a start that need not be a pre-token boundary.  Past the cut both neighbours name the first
boundary they see.  Where the two agree they have resynchronised: by induction from the first
chunk, whose start is a true boundary, each piece between two agreed boundaries holds whole
pre-tokens, so pieces are encoded alone and joined in order.  A text in which some pair of
neighbours doesn't agree (say, one run of letters longer than the overlap) is encoded in one go.
Decoding concatenates the raw bytes of the ids.

A piece that ends at a true boundary pre-tokenises alone as it does inside its text: the only
look-ahead of the pattern, ``\\s+(?!\\S)``, takes the same white space at an end of text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, table
from ._hashing import tidy

CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 10
#: Characters or ids that are worked on between two yields.
_BATCH = 1 << 18


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


@functools.lru_cache(maxsize=4)
def _encoding(raw: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})


@functools.lru_cache(maxsize=4)
def _table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, and the start and length of each id's."""
    ranks = _ranks(raw)
    start, length = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, np.int64)
    at, parts = 0, []
    for token, i in ranks.items():
        start[i], length[i] = at, len(token)
        parts.append(token)
        at += len(token)
    return np.frombuffer(b"".join(parts), np.uint8), start, length


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32, copy=False)))


def _encode_batches(raw, pattern: str, text: str, decoded: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replace column ``text`` by ``ids``, and add the bytes they stand for; other columns pass."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(raw.value, pattern)
        for batch in found:
            k = batch.schema.get_field_index(text)
            rest = [i for i in range(batch.num_columns) if i != k]
            names = [*(batch.schema.names[i] for i in rest), "ids", *([decoded] if decoded else [])]
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                t = batch.column(k)[i].as_py() or ""
                out.append(np.array(enc.encode_ordinary(t), dtype=np.int32))
                size += len(t)
                if size > _BATCH or i + 1 == batch.num_rows:
                    ids = _lists(out)
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(start, i + 1 - start) for j in rest), ids, *([_bytes(_table(raw.value), ids)] if decoded else [])], names)
                    start, size, out = i + 1, 0, []

    return tidy(run)


def _bytes(tokens: tuple[np.ndarray, np.ndarray, np.ndarray], lists: pa.Array) -> pa.Array:
    """The bytes that lists of ids stand for."""
    flat, start, length = tokens
    part, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    n = length[part]
    out_end = np.cumsum(n)
    index = np.arange(int(out_end[-1]) if len(n) else 0) + np.repeat(start[part] - (out_end - n), n)
    offsets = np.concatenate(([0], out_end))[ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(flat[index])])


def _boundaries(pattern, window: str) -> list[int]:
    ends = [m.end() for m in pattern.finditer(window)]
    return [0, *ends]


def _chunk_batches(raw, pattern: str, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc, pat = _encoding(raw.value, pattern), regex.compile(pattern)
        for batch in found:
            for r in batch.to_pylist():
                window, base, n, k = r["part"], r["base"], r["n"], r["k"]
                edges = [base + x for x in _boundaries(pat, window)]
                if base + len(window) < n:
                    edges = [x for x in edges if x < base + len(window)]
                after = lambda cut: next((x for x in edges if x >= cut), None)
                first = 0 if k == 0 else after(k * chunk)
                last = n if (k + 1) * chunk >= n else after((k + 1) * chunk)
                ok = first is not None and last is not None
                ids = enc.encode_ordinary(window[first - base : last - base]) if ok else []
                yield pa.RecordBatch.from_pydict(
                    {"h1": [r["h1"]], "h2": [r["h2"]], "n": [n], "k": [k], "first": [first], "last": [last], "ids": [ids]},
                    schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("ids", pa.list_(pa.int32()))]),
                )

    return tidy(run)


def encode(docs: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decoded: str | None = None) -> DataFrame:
    """Rows of ``docs`` with ``text`` replaced by ``ids``, an array of ints; with ``decoded``, the bytes that
    they stand for are added under that name, as ``decode`` does, by the same Python worker.

    A null or empty text gives an empty array; repeated rows stay; other columns pass unchanged
    (one called ``ids`` is replaced).  ``ranks`` is the content of a rank file, of bounded size,
    and is sent to all executors.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("0 < overlap_chars < chunk_chars is needed")
    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(ranks)
    src = docs.drop(*({"ids", decoded} - {text, None}))
    names = [c for c in src.columns if c != text]
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names), "ids array<int>", *([f"`{decoded}` binary"] if decoded else [])])
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    short = src.where(size <= chunk_chars).mapInArrow(_encode_batches(raw, pattern, text, decoded), schema)
    h = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]
    long = src.where(size > chunk_chars).withColumns({"__h1": h[0], "__h2": h[1]})
    # One copy of each long text is cut; its copies get the ids by the digest.
    whole = long.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.col(text).alias("t")).groupBy("h1", "h2").agg(F.first("t").alias("t")).withColumn("n", F.char_length("t"))
    cut = whole.select("h1", "h2", "n", "t", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / chunk_chars).cast("int"))).alias("k"))
    cut = cut.select("h1", "h2", "n", "k", F.greatest(F.lit(0), F.col("k") * chunk_chars - overlap_chars).alias("base"), "t")
    cut = cut.select("h1", "h2", "n", "k", "base", F.substring("t", F.col("base") + 1, (F.col("k") + 1) * chunk_chars + overlap_chars - F.col("base")).alias("part")).repartition("h1", "h2", "k")
    pieces = cut.mapInArrow(_chunk_batches(raw, pattern, chunk_chars), "h1 bigint, h2 bigint, n int, k int, first bigint, last bigint, ids array<int>")
    joined = pieces.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("k", "first", "last", "ids"))).alias("p"))
    joined = joined.withColumn("agreed", F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["last"].isNotNull() & F.element_at("p", i)["first"].isNotNull() & ((i == F.size("p")) | (F.element_at("p", i)["last"] == F.try_element_at("p", i + 1)["first"]))))
    joined = joined.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.when(F.coalesce("agreed", F.lit(False)), F.flatten(F.transform("p", lambda x: x["ids"]))).alias("ids"))
    long = long.join(joined.hint("merge"), ["__h1", "__h2"], "left")
    stitched = long.where(F.col("ids").isNotNull()).select(*names, "ids")
    stitched = decode(stitched, ranks, to=decoded) if decoded else stitched
    rest = long.where(F.col("ids").isNull()).select(*names, text).mapInArrow(_encode_batches(raw, pattern, text, decoded), schema)
    return short.unionByName(stitched).unionByName(rest)


def _decode_batches(raw, ids: str, to: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _table(raw.value)
        for batch in found:
            lists = batch.column(batch.schema.get_field_index(ids))
            ends, a = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + _BATCH, side="right")) - 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), _bytes(tokens, lists.slice(a, b - a))], [*batch.schema.names, to])
                a = b

    return tidy(run)


def decode(encoded: DataFrame, ranks: bytes, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for.  Null or empty: no bytes.  An unknown id is an error."""
    raw = encoded.sparkSession.sparkContext.broadcast(ranks)
    src = encoded.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema), f"`{to}` binary"])
    return src.mapInArrow(_decode_batches(raw, ids, to), schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
