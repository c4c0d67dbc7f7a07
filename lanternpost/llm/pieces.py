"""Pieces and scores of a public SentencePiece model file."""

from __future__ import annotations

from dataclasses import dataclass

import sentencepiece

MARKER = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Normal pieces by text, and the ids of the 256 byte pieces."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[str]


def load(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    normal = [i for i in range(len(texts)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    at = {t: i for i, t in enumerate(texts)}
    return Vocabulary(
        {texts[i]: model.get_score(i) for i in normal}, {texts[i]: i for i in normal}, [at[f"<0x{b:02X}>"] for b in range(256)], texts
    )


def units(text: str) -> list[str]:
    """Runs of white-space markers with the characters up to the next marker.

    No piece holds a marker after another character, so units are encoded on their own.
    """
    marked = text.split(MARKER)
    out = []
    lead = marked[0]
    if lead:
        out.append(lead)
    run = ""
    for part in marked[1:]:
        run += MARKER
        if part:
            out.append(run + part)
            run = ""
    if run:
        out.append(run)
    return out


def crossing(vocabulary: Vocabulary) -> list[str]:
    """Pieces that hold a marker after another character; empty for a model that units can split."""
    return [p for p in vocabulary.scores if MARKER in p.lstrip(MARKER)]
