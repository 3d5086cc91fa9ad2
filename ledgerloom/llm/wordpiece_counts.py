"""Operator 10: greedy word-piece lengths by a longest-match automaton, without building pieces."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.memo import Memo
from ledgerloom.llm.runtime import arrow_map, id_and_text

#: The vocabulary file's rule for words, and its mark of a word's end.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
DEAD = -1


class LongestMatchCounter:
    """Number of pieces that greedy longest-first matching cuts a word into.

    ``initial`` are pieces that may start a word, ``inner`` those that may
    follow; both are sequences of symbols (a string's characters, or any tuple). The trie of both has a node per prefix. A failure link
    leads from a node to the node for what is left after the longest pieces
    have been taken off the front of its string, and ``popped`` says how many those were. Reading a symbol follows
    failure links until a child exists, adding the popped counts; a word's
    end pops the rest. Each symbol is read once and every link shortens what is pending, so
    the time is linear in the word, with no lookup of substrings.
    """

    def __init__(self, initial, inner):
        self.child: list[dict] = [{}, {}]  # 0: start of a word, 1: after a piece
        self.final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for symbol in piece:
                    node = self.child[node].setdefault(symbol, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                        self.final.append(False)
                self.final[node] |= len(piece) > 0
        self.link, self.popped = [DEAD] * len(self.child), [0] * len(self.child)
        waiting = deque([0, 1])
        while waiting:
            parent = waiting.popleft()
            for symbol, node in self.child[parent].items():
                waiting.append(node)
                if self.final[node]:
                    self.link[node], self.popped[node] = 1, 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at != DEAD and symbol not in self.child[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at != DEAD:
                    self.link[node], self.popped[node] = self.child[at][symbol], count

    def count(self, word) -> int:
        """Pieces of ``word``; 1 (the unknown piece) where the greedy match gets stuck, 0 for nothing."""
        child, link, popped = self.child, self.link, self.popped
        node, total = 0, 0
        for symbol in word:
            step = child[node].get(symbol)
            while step is None:
                total += popped[node]
                node = link[node]
                if node == DEAD:
                    return 1
                step = child[node].get(symbol)
            node = step
        while node > 1:
            total += popped[node]
            node = link[node]
            if node == DEAD:
                return 1
        return total


def marked(word: bytes, final: bool = True) -> tuple[int, ...]:
    """The symbols of a word or piece: its bytes, of which the last, where it ends a word, is another symbol than elsewhere."""
    return (*word[:-1], word[-1] + (256 if final else 0)) if word else ()


class FilePieceCounter:
    """Counts by the pieces of a vocabulary file, some of which stand only where a word ends.

    The file has every single byte with and without the mark of an end, so no word gets stuck.
    """

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.pieces = {marked(bytes(to_byte[c] for c in p.removesuffix(END)), p.endswith(END)) for p in vocabulary}
        self.counter = LongestMatchCounter(self.pieces, self.pieces)
        self.memo = Memo(self._count, memo)

    def _count(self, word: str) -> int:
        return self.counter.count(marked(word.encode("utf-8", "surrogatepass")))

    def of_text(self, text: str) -> tuple[int, int]:
        """(words, pieces) of a text, composed and lower-cased."""
        words = WORDS.findall(unicodedata.normalize("NFC", text).lower())
        return len(words), sum(map(self.memo.__getitem__, words))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> FilePieceCounter:
    return FilePieceCounter(path)


def wordpiece_counts(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words`` and ``n_tokens`` (long) of the whole text.

    Words follow the vocabulary's own rule, composed (NFC) and in lower case. Pieces are matched greedily over UTF-8 bytes, the
    last of a word with the vocabulary's mark of an end, so a piece counts only where the vocabulary has it. All
    bytes are in the vocabulary with and without that mark, so no word is unknown. One pass, no shuffle.

    Defined cases: null, empty and blank texts count 0; a null id stays null;
    repeated rows count alike; other columns are ignored; no rows give no rows. Memory is bounded
    by one Arrow batch and a bounded memo of short words.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(vocabulary)
        rows = [c.of_text(t or "") for t in batch.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("__id"), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col)
    return arrow_map(rows, fn,
        f"doc_id {rows.schema['__id'].dataType.simpleString()}, n_words bigint, n_tokens bigint").withColumnRenamed(
        "doc_id", id_col)
