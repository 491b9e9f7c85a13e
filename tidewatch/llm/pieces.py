"""The piece table of a SentencePiece BPE model, and texts cut where no piece can reach across."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MARK = "▁"  # fixed value: what the library writes for a space


@dataclass(frozen=True)
class PieceTable:
    """Pieces of text only (no control, byte or unused pieces), with ids, ranks and byte pieces' ids.

    Scores of a BPE model are negative merge ranks; `rank` orders pieces by score, 0 first merged.
    """
    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    rank: dict[str, int]
    bytes: tuple[int, ...]  # id of each byte's piece
    alone: tuple[int, ...]  # ASCII bytes that are in no piece but their own


@lru_cache(2)
def piece_table(model: str) -> PieceTable:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    every = range(library.get_piece_size())
    kept = [i for i in every if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    pieces = [library.id_to_piece(i) for i in kept]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a space after another character: words can't be cut apart")
    if library.encode("  a") != library.encode_as_ids("  a") or library.decode(library.encode(" Ａ  b")) != " Ａ  b":
        raise ValueError("the model changes texts before it cuts them")
    # Equal scores keep equal ranks: the leftmost pair then goes first.
    order = {s: k for k, s in enumerate(sorted({library.get_score(i) for i in kept}, reverse=True))}
    rank = {p: order[library.get_score(i)] for p, i in zip(pieces, kept)}
    as_bytes = {library.id_to_piece(i): i for i in every if library.is_byte(i)}
    joined = set("".join(p for p in pieces if len(p) > 1)) | {" "}
    alone = tuple(b for b in range(128) if chr(b) not in joined)
    return PieceTable(tuple(pieces), tuple(kept), rank, tuple(as_bytes[f"<0x{b:02X}>"] for b in range(256)), alone)


def bundled_model() -> str:
    """The place of the public 32,000-piece model; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_SPACE = 0x20
_MARK_BYTES = MARK.encode()


def pre_tokens(data: np.ndarray, offsets: np.ndarray, alone=()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in `data` of the parts of texts that no piece crosses.

    The library puts a space before a text that isn't empty and takes spaces for marks. As marks occur
    in pieces at their beginning only, a part is a run of marks and the other characters up to the
    next mark; bytes `alone` (see PieceTable) are parts of their own. `data` must hold texts with that space put before and marks in texts turned to spaces
    (see `spaced`).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = data == _SPACE
    begins = space & np.append(True, ~space[:-1])
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    if len(alone):
        lone = np.zeros(256, bool)
        lone[list(alone)] = True
        single = lone[data]
        begins |= single
        begins[1:] |= single[:-1]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as the library reads them: a space before each that isn't empty, marks as spaces."""
    a, b, c = _MARK_BYTES
    if len(data) > 2 and ((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)).any():
        raw = data.tobytes()
        texts = [raw[s:e].replace(_MARK_BYTES, b" ") for s, e in zip(offsets[:-1], offsets[1:])]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
    full = np.diff(offsets) > 0
    out = np.full(len(data) + int(full.sum()), _SPACE, np.uint8)
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    shift = np.repeat(np.cumsum(full), np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, moved
