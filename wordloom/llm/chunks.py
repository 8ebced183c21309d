"""Cutting a text at its spaces so that byte-level BPE can encode the pieces one by one.

The pre-tokeniser's pattern attaches one space to the word after it, so a text may be cut before any
space, except inside a run of white space where that space isn't the run's last character. Texts
with such runs (``uncut``) are left whole.
"""

from __future__ import annotations

import re
_ODD = re.compile(r"\s \s|\s \Z")


def uncut(text: str) -> bool:
    return _ODD.search(text) is not None


class Encoded(dict):
    """Encodings by chunk, bounded: past ``limit`` entries only those of the chunks just wanted stay."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def learn(self, wanted: set[str], encode) -> None:
        if new := wanted.difference(self):
            if len(self) + len(new) > self.limit:
                kept = {c: self[c] for c in wanted if c in self}
                self.clear()
                self.update(kept)
            new = sorted(new)
            self.update(zip(new, encode(new), strict=True))
