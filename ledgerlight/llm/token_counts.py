"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and an end-of-word mark.  Where a word
leaves the trie, the longest pieces read so far are fixed: every node holds a
failure link to the node of what then remains unread, and the number of
pieces popped on the way, both computed once from the parent.  A word is thus
read once, byte by byte, and its number of pieces is a sum of popped counts;
no piece is ever built.

Words are those of the vocabulary's own pre-tokeniser (NFC, lower case; white
space dropped).  A word whose last piece has no end-of-word form counts that
piece without the mark.  Every byte is a piece, so any text has a count.

Defined cases: a null or empty text has no words and no pieces; repeated rows
each get a row; null ids stay null; an empty table gives an empty result;
only the two named columns are read.  A text is read in stretches cut at
white space, so memory doesn't follow its length.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import text_slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END_MARK = "</w>"
END = 256
STRETCH = 1 << 16
#: Words whose counts a worker keeps; it starts anew beyond that.
KEPT_WORDS = 300_000


def byte_letters() -> dict[str, int]:
    """The usual printable letter of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces as symbols: bytes, and END for the end-of-word mark."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    letters = byte_letters()
    out = []
    for piece in data["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith(END_MARK)
            body = piece[:-len(END_MARK)] if ends else piece
            out.append((*[letters[c] for c in body], *[END] * ends))
    return out


class Automaton:
    """Trie with failure links and popped counts; ``pieces(word)`` is the greedy piece count."""

    def __init__(self, vocabulary: list[tuple[int, ...]]) -> None:
        self.goto: list[dict[int, int]] = [{}]
        weight = {0: 0}
        for piece, w in [*[((b,), 1) for b in range(256)], ((END,), 0), *[(p, 1) for p in vocabulary]]:
            node = 0
            for s in piece:
                step = self.goto[node].get(s)
                if step is None:
                    step = self.goto[node][s] = len(self.goto)
                    self.goto.append({})
                node = step
            weight.setdefault(node, w)
        self.fail = [0] * len(self.goto)
        self.popped = [0] * len(self.goto)
        queue = deque((0, s, n) for s, n in self.goto[0].items())
        while queue:  # by depth: what remains is shorter, so its links are known
            parent, symbol, node = queue.popleft()
            if node in weight:
                self.fail[node], self.popped[node] = 0, weight[node]
            else:
                z, count = self.fail[parent], self.popped[parent]
                while symbol not in self.goto[z]:  # ends at the root, which has every symbol
                    count += self.popped[z]
                    z = self.fail[z]
                self.fail[node], self.popped[node] = self.goto[z][symbol], count
            queue.extend((node, s, n) for s, n in self.goto[node].items())

    def pieces(self, word: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node = count = 0
        for s in (*word, END):
            step = goto[node].get(s)
            while step is None:
                count += popped[node]
                node = fail[node]
                step = goto[node].get(s)
            node = step
        while node:
            count += popped[node]
            node = fail[node]
        return count


class WordCounts(dict):
    """Pieces of each word seen lately."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self[word] = self.automaton.pieces(word.encode())
        return n


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(Automaton(read_vocabulary(path)))


def stretches(text: str) -> Iterator[str]:
    """Cuts of the text at white space, of about STRETCH characters."""
    import regex

    space, start = regex.compile(r"\s"), 0
    while start < len(text):
        cut = space.search(text, start + STRETCH) if start + STRETCH < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def count_text(text: str, counts: WordCounts, compiled) -> tuple[int, int, int]:
    """Words, pieces, and the most pieces in a word."""
    import unicodedata

    words = pieces = most = 0
    for part in stretches(text):
        found = list(map(counts.__getitem__, compiled.findall(unicodedata.normalize("NFC", part).lower())))
        words += len(found)
        pieces += sum(found)
        most = max(most, max(found, default=0))
    return words, pieces, most


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces and max_word_pieces of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        counts, compiled = word_counts(path), regex.compile(PATTERN)
        for batch in text_slices(batches, "text", 4 << 20):
            rows = [count_text(t, counts, compiled) for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]],
                ["doc_id", "n_words", "n_pieces", "max_word_pieces"])
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_pieces long, "
                                "max_word_pieces long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
