"""Piece vocabularies: read once on the driver from a SentencePiece model file, then broadcast (size of the file)."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Default model file; every operator takes another path as a parameter.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


@dataclass(eq=False)
class Vocabulary:
    """``pieces``: text (space mark as a space) -> id; ``byte_ids``: the 256 byte pieces; ``log_p``: by id."""

    pieces: dict[str, int]
    byte_ids: list[int]
    log_p: list[float]
    as_bytes: list[bytes]


def read(path: str = MODEL_PATH) -> Vocabulary:
    """Pieces, byte pieces and log-probabilities of a model file.

    A BPE model scores a piece by minus its rank; its ranks become
    Zipf-Mandelbrot probabilities, 1 / (rank + 2.7), normalised. Other models
    keep their scores. A byte piece costs as much as the rarest piece and 10 more.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces, byte_ids = {}, [-1] * 256
    log_p, as_bytes = [0.0] * size, [b""] * size
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value], as_bytes[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text = piece.replace(MARK, " ")
            if " " in text.lstrip(" ") or "\n" in text:
                raise ValueError(f"piece {i}: a space mark after other characters, or a line end")
            pieces[text], as_bytes[i] = i, text.encode()
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces")
    scores = {i: model.get_score(i) for i in pieces.values()}
    if all(s == -r for r, s in enumerate(sorted(scores.values(), reverse=True))):
        total = sum(1.0 / (2.7 - s) for s in scores.values())
        scores = {i: -math.log((2.7 - s) * total) for i, s in scores.items()}
    for i, s in scores.items():
        log_p[i] = s
    worst = min(scores.values()) - 10.0
    for i in byte_ids:
        log_p[i] = worst
    return Vocabulary(pieces, byte_ids, log_p, as_bytes)
