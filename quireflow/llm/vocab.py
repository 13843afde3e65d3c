"""Vocabulary files of public tokenizers, read by the driver, and what a Python worker keeps of them.

A vocabulary has a fixed size (tens of thousands of pieces), so it travels with
the job. What is made of it stays in the worker process from task to task.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def kept(name: str, make: Callable[[], T]) -> T:
    """The object of this name in this process, made at its first use."""
    store = sys.__dict__.setdefault("_quireflow_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def rank_file(path: str) -> list[bytes]:
    """Pieces of a rank file, in the order of their ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("the ranks must run from 0 without gaps")
    return pieces


def whole_pieces(path: str) -> tuple[list[str], frozenset[int]]:
    """Pieces of a SentencePiece model without its control pieces, and the bytes that it has pieces of."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i) for i in known if not model.is_byte(i)]
    return pieces, frozenset(int(model.id_to_piece(i)[1:-1], 16) for i in known if model.is_byte(i))


def word_start_pieces(path: str) -> list[str]:
    """The pieces that hold a character of a word: no byte pieces, and not the word-start mark alone."""
    return [piece for piece in whole_pieces(path)[0] if piece != "▁"]
