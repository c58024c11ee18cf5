"""Pieces with log scores, and the pre-tokens that they are looked for in.

A text is cut before each space and around each line break and each literal
whitespace marker; a space becomes the marker, the text's begin gets one
(`dummy prefix`), and pieces never cross these cuts. Literal markers always
become bytes, so decoding gives every text back exactly. The best segmentation
has the highest sum of scores; of equal ones the one whose last piece is longer.
A character that is no piece costs `unknown` and becomes its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

MARK = "▁"
CUTS = re.compile(f"(\n|{MARK})")


@dataclass
class Pieces:
    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte, control, unknown or unreached
    unknown: float

    def normal(self) -> Iterator[tuple[int, str, float]]:
        return ((i, p, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k == "normal" and p and "\n" not in p)

    def byte_ids(self) -> list[int]:
        """Ids of the 256 bytes; the unknown id where a byte has none."""
        unknown = self.kinds.index("unknown") if "unknown" in self.kinds else 0
        found = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == "byte"}
        return [found.get(f"<0x{b:02X}>", unknown) for b in range(256)]


def load_pieces(path: str) -> Pieces:
    """Pieces of a SentencePiece model file.

    Files of merge-based models store minus the merge rank in place of a log
    score; it becomes one by Zipf's law: minus the log of rank plus one, normalised.
    Pieces that such a file excludes by a score of -1e9 can be decoded, not chosen;
    only the lone marker can, at the lowest score.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal" for i in range(n)]
    scores = [float(sp.get_score(i)) for i in range(n)]
    kinds = ["unreached" if k == "normal" and s <= -1e8 else k for k, s in zip(kinds, scores, strict=True)]
    normal = [scores[i] for i in range(n) if kinds[i] == "normal"]
    if normal and all(s == int(s) for s in normal) and len(set(normal)) == len(normal):
        log_sum = math.log(sum(1 / (1 - s) for s in normal))
        scores = [-math.log(1 - s) - log_sum if k == "normal" else s for s, k in zip(scores, kinds, strict=True)]
        normal = [s for s, k in zip(scores, kinds, strict=True) if k == "normal"]
    pieces = [sp.id_to_piece(i) for i in range(n)]
    if MARK in pieces and kinds[pieces.index(MARK)] == "unreached":  # a lone space must stay a space
        at = pieces.index(MARK)
        kinds[at], scores[at] = "normal", min(normal, default=0.0)
    return Pieces(pieces, scores, kinds, min(normal, default=0.0) - 10.0)


#: Stands for a literal marker; no other pre-token holds both characters.
LITERAL = MARK + "\n"


def segments(piece: str) -> list[str]:
    """Pre-tokens of what stands between two spaces."""
    parts = CUTS.split(piece)
    parts[0] = MARK + parts[0]
    return [LITERAL if i % 2 and p == MARK else p for i, p in enumerate(parts) if p]
