"""Token counts by a linear longest-match automaton.

The greedy longest-match pieces of a word, with the word-start mark before it, are
counted without building them. The vocabulary is a trie. Each state has a failure
link, to the state reached after the longest pieces that must be taken off its
string are popped, and the number of those pieces, both computed once. A word is
read once; each failure adds its popped pieces, and since it shortens what is
held, the work is linear.

A character with which no piece begins that fits is counted by its byte pieces. A
word with a character that has neither is one unknown token; a model with all 256
byte pieces has no unknown words. Words are the pieces of a text between white
space. Words seen before are looked up.

Defined results: null and blank texts have no words and no tokens; repeated rows
are counted alike; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .vocab import kept

START = "▁"
#: Words a worker keeps the counts of; then it starts anew. It bounds memory, not results.
KEPT_WORDS = 500_000
_LONG = 200


class Automaton:
    """Piece counts; None where neither pieces nor byte pieces fit."""

    def __init__(self, pieces: list[str], start: str = START, byte_pieces: frozenset[int] = frozenset()) -> None:
        self.start, self.byte_pieces = start, byte_pieces
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            state = 0
            for c in piece:
                state = self.next[state].setdefault(c, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    ends.append(False)
            ends[state] = True
        self.fail: list[int] = [-1] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        level = [(0, c, t) for c, t in self.next[0].items()]
        while level:
            following = []
            for parent, c, state in level:
                if ends[state]:
                    self.fail[state], self.pops[state] = 0, 1
                else:
                    popped, at = self.pops[parent], self.fail[parent]
                    while at > 0 and c not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0 and c in self.next[at]:
                        self.fail[state], self.pops[state] = self.next[at][c], popped
                    elif (at == 0 or parent == 0) and (own := self._bytes(c)):
                        self.fail[state], self.pops[state] = 0, popped + own
                following += [(state, d, t) for d, t in self.next[state].items()]
            level = following

    def _bytes(self, c: str) -> int:
        """Byte pieces of a character; 0 if one is lacking."""
        encoded = c.encode()
        return len(encoded) if self.byte_pieces.issuperset(encoded) else 0

    def count(self, word: str) -> int | None:
        following, fail, pops = self.next, self.fail, self.pops
        state = total = 0
        for c in self.start + word:
            while c not in following[state]:
                if state == 0:
                    if not (own := self._bytes(c)):
                        return None
                    total += own
                    break
                if fail[state] < 0:
                    return None
                total += pops[state]
                state = fail[state]
            else:
                state = following[state][c]
        while state != 0:
            if fail[state] < 0:
                return None
            total += pops[state]
            state = fail[state]
        return total


def token_counts(docs: DataFrame, pieces: list[str], start: str = START, byte_pieces: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row; an unknown word is one token."""
    name = f"automaton-{hashlib.sha256(' '.join(pieces).encode()).hexdigest()}-{start}-{sorted(byte_pieces)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = kept(name, lambda: (Automaton(pieces, start, byte_pieces), {}))
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                if len(counts) > KEPT_WORDS:
                    counts.clear()
                own = {}
                for word in set(words).difference(counts):
                    found = automaton.count(word)
                    (own if len(word) > _LONG else counts)[word] = 0 if found is None else found
                each = [counts[w] if w in counts else own[w] for w in words] if own else list(map(counts.__getitem__, words))
                unknown = each.count(0)
                rows.append((len(words), sum(each) + unknown, unknown))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
