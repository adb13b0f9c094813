"""Whole texts to token ids of a byte-level file, by units that no token can cross.

A byte-level file splits a text into words before it merges anything, and its words never run from a
visible character into a following space or line feed. A text may therefore be cut at any such place
without a change in its ids. To count, the encoder cuts there everywhere, keeps the counts of units in a
bounded dictionary and hands only new units to the library, in batches. Special strings hold no spaces, so
they stay inside a unit and the library treats them as it does by default.

The same vocabulary as a rank file of `tiktoken` gives ids faster. Both agree on every
text if each token's own bytes encode to that token: the merges inside a stretch depend on nothing outside
it, so two parts that could join into a token are the very two of which the token was made. The tests
check this for all tokens. Texts with other than common characters still go to `tokenizers`, since the
libraries' classes of letters may be of different Unicode versions.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

#: A unit begins at a space or line feed after a visible ASCII, Latin, Greek or Cyrillic character.
_BEFORE = re.compile(r"(?<=[!-~¡-ԯ])(?=[ \n])")
#: Texts of characters in whose classes the libraries cannot differ.
_COMMON = re.compile(r"[\t\n -~¡-ԣ‐-‧‰-⁞€]*\Z")

_loaded: dict[tuple, UnitEncoder] = {}


class UnitEncoder:
    """Token ids of texts, or their numbers only.

    `ranks` may name a rank file of the same vocabulary. `remembered` bounds the dictionary of units,
    `piece` the characters handled at once.
    """

    def __init__(self, path: str, ranks: str | None = None, remembered: int = 400_000, piece: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered, self.piece = remembered, piece
        self.known: dict[str, bytes | int] = {}
        self.fast = _ranked(ranks) if ranks else None

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in parts that end at safe places; a stretch without one stays whole."""
        at = 0
        while len(text) - at > self.piece:
            cut = _BEFORE.search(text, at + self.piece)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added special tokens."""
        return [b"".join(map(self._ids, self.pieces(text))) for text in texts]

    def _ids(self, piece: str) -> bytes:
        if self.fast and _COMMON.match(piece) and not any(s in piece for s in self.special):
            return self.fast(piece).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text. Only units not seen before are encoded, in batches."""
        split = [[_BEFORE.split(p) for p in self.pieces(text) if p] for text in texts]
        new = {u for pieces in split for units in pieces for u in units}.difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = {u for pieces in split for units in pieces for u in units}
        rest = list(new)
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return [sum(sum(map(self.known.__getitem__, units)) for units in pieces) for pieces in split]


def _ranked(path: str) -> Callable[[str], np.ndarray]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=())


def encoder(path: str, ranks: str | None = None) -> UnitEncoder:
    """The encoder of a file, loaded once in each Python worker."""
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = UnitEncoder(path, ranks)
    return _loaded[path, ranks]
