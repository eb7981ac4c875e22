"""Word-piece counts by greedy longest match, without building pieces.

Method: a linear longest-match automaton.  A trie of the vocabulary has failure links: from the
node of a string that can't go on, the link leads to the node of what is left after the longest
prefixes have been popped as pieces, and the number of popped pieces is kept with the link.  A word
is then read once, one step a character; the count is the sum of the numbers on the links taken.

A word is a lower-cased run of non-blanks, as bytes, and an end mark.  Its count is kept for the
other places where it stands, in a table of bounded size.
"""

from __future__ import annotations

import functools
import json
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

END = "</w>"
_MEMO = 1 << 18


class Automaton:
    """Pieces are strings; those that end with ``end`` match at the end of a word only.

    A character without a piece of its own counts as one unknown piece, and the end mark, where no
    piece takes it in, as none.  So every string of the trie can be popped and each node but the
    root has a failure link.
    """

    def __init__(self, pieces: set[str], end: str = END):
        self.end = "\0"
        strings = {p[: -len(end)] + self.end if p.endswith(end) else p for p in pieces} - {""}
        strings |= {c for p in strings for c in p}
        self.next: list[dict[str, int]] = [{}]
        is_piece = [False]
        for p in sorted(strings):
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    is_piece.append(False)
                at = self.next[at][c]
            is_piece[at] = True
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        todo = deque((0, c, v) for c, v in self.next[0].items())
        while todo:
            parent, c, v = todo.popleft()
            if is_piece[v]:
                self.popped[v] = int(parent != 0 or c != self.end)
            else:
                at, count = self.fail[parent], self.popped[parent]
                while c not in self.next[at]:
                    at, count = self.fail[at], count + self.popped[at]
                self.fail[v], self.popped[v] = self.next[at][c], count
            todo.extend((v, d, w) for d, w in self.next[v].items())

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of the word."""
        total, at = 0, 0
        for c in word + self.end:
            while c not in self.next[at]:
                if at == 0:
                    total += c != self.end
                    break
                total, at = total + self.popped[at], self.fail[at]
            else:
                at = self.next[at][c]
        while at:
            total, at = total + self.popped[at], self.fail[at]
        return total


def read_pieces(path: str) -> list[str]:
    """The vocabulary of a tokenizer file, in the order of its ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [p for p, _ in sorted(vocab.items(), key=lambda x: x[1])]


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


@functools.lru_cache(maxsize=2)
def _automaton(pieces: tuple[str, ...]) -> Automaton:
    return Automaton(set(pieces))


def _count_batches(pieces, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, letters, memo = _automaton(pieces.value), _byte_letters(), {}
        spell = "".join(letters[b] for b in range(256))
        for batch in found:
            k = batch.schema.get_field_index(text)
            n_words, n_pieces = [], []
            for t in batch.column(k):
                words = Counter((t.as_py() or "").lower().split())
                total = 0
                for w, times in words.items():
                    c = memo.get(w)
                    if c is None:
                        if len(memo) >= _MEMO:
                            memo.clear()
                        c = memo[w] = auto.count(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(spell))
                    total += c * times
                n_words.append(sum(words.values()))
                n_pieces.append(total)
            rest = [i for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], [*(batch.schema.names[i] for i in rest), "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str], *, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_words`` and ``n_tokens``.  Null or empty text: 0 and 0."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(pieces))
    src = docs.drop("n_words", "n_tokens", "__text").withColumn("__text", F.col(text)).drop(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text"), "n_words bigint, n_tokens bigint"])
    return src.mapInArrow(_count_batches(sent, "__text"), schema)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, read_pieces(public_tokenizers.path("word_bpe_49k.json")))
