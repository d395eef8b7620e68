"""Ids of texts by a public byte-level tokenizer, and back.

A text is cut before each space that stands between two characters that no version of Unicode counts as white space.
Byte-level tokenizers never let a token run across such a place, so a part's ids don't depend on what is around it,
and parts that return are looked up rather than tokenised again; so are marks behind a letter, which never join it either.
Every id comes from the tokenizer itself; runs of white space and anything else unusual stay uncut within a part.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

_SAFE = "!-~¡-ᙿ、-퟿"
#: A space between two characters that are surely none.
_CUT = re.compile(f"(?<=[{_SAFE}]) (?=[{_SAFE}])")
#: Anything but these characters, spaces and line ends; a text without it is cut without a pattern.
_ODD = re.compile(f"[^{_SAFE} \n]")
_MARKS = ",.;:!?)"
_SAFE_END = re.compile(f"[{_SAFE}]\\Z")
#: Parts remembered at most, and characters of one at most.
_HELD, _LONG = 1_500_000, 32


class Tokens:
    """The tokenizer in the file ``path``; ``plain``: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = plain
        self.size = self.own.get_vocab_size()
        self.parts: dict[str, bytes] = {}  # ids of a space and a part, as little-endian 32-bit numbers
        self.marks: dict[str, bytes] = {}
        self.widths = np.array([len(b) for b in self.bytes_of])

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # fast: without offsets

    def _learn(self, fresh: list[str]) -> None:
        """Tokenise parts one behind the other, and tell their ids apart by the bytes that these stand for."""
        ends_in = {p: p.rstrip(_MARKS) for p in fresh if p[-1] in _MARKS}
        ends_in = {p: base for p, base in ends_in.items() if base and base[-1].isascii() and base[-1].isalpha()}
        whole = [p for p in dict.fromkeys([*(p for p in fresh if p not in ends_in), *ends_in.values()]) if p not in self.parts]
        if whole:
            ids = self._encoded(" " + " ".join(whole))
            ends = np.cumsum([len(p.encode()) + 1 for p in whole])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            raw = memoryview(ids.tobytes())
            at = 0
            for part, stop in zip(whole, (4 * cuts).tolist(), strict=True):
                self.parts[part] = bytes(raw[at:stop])
                at = stop
        for part, base in ends_in.items():
            mark = part[len(base) :]
            if mark not in self.marks:
                self.marks[mark] = self._encoded(mark).tobytes()
            self.parts[part] = self.parts[base] + self.marks[mark]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Parts of ``text``: the first as it stands, the others behind a space."""
        if _ODD.search(text) or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return _CUT.split(text)
        return text.split(" ")

    def ids(self, text: str) -> np.ndarray:
        """Ids of ``text`` as 32-bit numbers."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """``ids`` of each text."""
        if len(self.parts) > _HELD or len(self.marks) > _HELD:
            self.parts.clear()
            self.marks.clear()
        look, out, fresh = self.parts.get, [], {}
        for text in texts:
            first, *rest = self.cut(text)
            # What ends a text may end in white space, which must not get a neighbour.
            last = self._encoded(" " + rest.pop()).tobytes() if rest and not _SAFE_END.search(rest[-1]) else b""
            found = list(map(look, rest))
            if None in found:
                fresh.update((p, None) for p, f in zip(rest, found, strict=True) if f is None)
            out.append((self._encoded(first).tobytes(), rest, found, last))
        if fresh:
            self._learn(list(fresh))
        known = self.parts.__getitem__
        ids = [np.frombuffer(b"".join([first, *(map(known, rest) if None in found else found), last]), "<u4") for first, rest, found, last in out]
        for part in fresh:
            if len(part) > _LONG:
                self.parts.pop(part, None)
                self.parts.pop(part.rstrip(_MARKS), None)
        return ids

    @property
    def bytes_of(self) -> list[bytes]:
        """The bytes of each id. Byte-level vocabularies write a byte that isn't printable as a character from 256 on."""
        if "_bytes" not in self.__dict__:
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
            special = {i for i, _ in self.own.get_added_tokens_decoder().items()}
            names = [self.own.id_to_token(i) for i in range(self.size)]
            self._bytes = [s.encode() if i in special else bytes(byte[c] for c in s) for i, s in enumerate(names)]
        return self._bytes


@cache
def tokens(path: str | None = None, plain: bool = False) -> Tokens:
    """The tokenizer of a file, by default the public one, once in a process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokens(path, plain)
