"""Encoding with the tokenizers library, once per distinct piece of text.

Two ways of cutting a text into pieces that the tokenizer never joins:
- spaced (byte-level BPE): the pre-tokenizer's own runs, of letters, digits and other
  characters with the blank before them, in texts in ASCII and Latin-1 letters without
  apostrophes; other texts are cut behind each run of characters that aren't blank.
- words (a tokenizer that lower-cases and drops white space): runs of letters, runs of
  other characters, and single digits, of texts in ASCII and Latin-1 letters without
  apostrophes; other texts are cut at white space.
A text's ids are its pieces' ids in order (tests compare whole texts). Each worker keeps
the ids of the pieces it has met, up to CACHE_PIECES, and starts afresh beyond that. New
pieces are encoded together, as one text, and told apart by the tokens that begin (or
end) a piece. Texts with any other white space, or with one of the tokenizer's special
strings, are encoded as they are.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from pathlib import Path

import numpy as np

CACHE_PIECES = 800_000
#: Pieces longer than this are encoded but not kept.
LONGEST_KEPT = 64
#: Characters of texts whose new pieces are encoded together.
AT_ONCE = 1 << 20

_SPACED = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_RUNS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \nA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \n]+(?![^ \n])|[ \n]+").findall
_OTHER_SPACE = re.compile(r"[^\S \n]").search
_NOT_LATIN = re.compile(r"[^\n -&(-~À-ÿ]").search
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ \na-z0-9ß-öø-ÿ]+").findall
_ENCODERS: dict[tuple[int, int, bool], "PieceEncoder"] = {}


class PieceEncoder:
    def __init__(self, tokenizer, words: bool = False):
        self.tokenizer, self.words = tokenizer, words
        self.cache: dict[str, bytes] = {}
        #: Strings that the tokenizer takes for one token wherever they stand; texts that hold one are encoded whole.
        self.specials = sorted({c.lower() if words else c for c in (t.content for t in tokenizer.get_added_tokens_decoder().values())})
        vocabulary = tokenizer.get_vocab()
        #: Which tokens end a word, or begin with a blank.
        self.marks = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith("</w>") if words else token.startswith("Ġ")

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str], glue: str) -> list[bytes]:
        raw = self._raw([glue.join(pieces)])[0]
        at = np.flatnonzero(self.marks[np.frombuffer(raw, dtype=np.uint32)])
        if len(at) != len(pieces):  # some piece holds several marks; none holds none
            half = len(pieces) // 2
            return self._raw(pieces) if half < 32 else self._together(pieces[:half], glue) + self._together(pieces[half:], glue)
        cuts = [0, *(4 * (at + 1)).tolist()] if self.words else [*(4 * at).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: list[str], cut: bool) -> dict[str, bytes]:
        """cut: the pieces are single words."""
        if self.words:
            joined, rest = (pieces, []) if cut else ([], pieces)
        else:
            joined = [p for p in pieces if p[0] == " " and len(p) > 1 and p[1] not in " \n"]
            rest = [p for p in pieces if not (p[0] == " " and len(p) > 1 and p[1] not in " \n")]
        out = dict(zip(joined, self._together(joined, " " if self.words else ""), strict=True)) if joined else {}
        out.update(zip(rest, self._raw(rest), strict=True))
        return out

    def encode(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers in this machine's (little-endian) order."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; pieces that are new to the worker are encoded together, AT_ONCE characters of texts at a time."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= AT_ONCE or i == len(texts) - 1:
                out += self._encode_some(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _pieces(self, text: str) -> tuple[bool, list[str] | None]:
        """Whether the pieces are single words, and the pieces; None: the text is encoded as it is."""
        lowered = text.lower() if self.words else text
        if any(special in lowered for special in self.specials):
            return False, None
        if not _NOT_LATIN(text):
            return True, _WORDS(lowered) if self.words else _RUNS(text)
        if _OTHER_SPACE(text):
            return False, None
        return False, text.split() if self.words else _SPACED(text)

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        get, out, open_ = self.cache.get, [], []
        new: dict[bool, set[str]] = {True: set(), False: set()}
        for i, text in enumerate(texts):
            cut, pieces = self._pieces(text)
            if pieces is None:
                out.append(self._raw([text])[0])
                continue
            ids = list(map(get, pieces))
            try:
                out.append(b"".join(ids))
            except TypeError:  # some pieces are new
                new[cut].update([p for p, x in zip(pieces, ids, strict=True) if x is None])
                open_.append((i, pieces, ids))
                out.append(b"")
        learnt: dict[str, bytes] = {}
        for cut, pieces in new.items():
            learnt.update(self._learn([p for p in pieces if p not in learnt], cut))
        for i, pieces, ids in open_:
            out[i] = b"".join([learnt[p] if x is None else x for p, x in zip(pieces, ids, strict=True)])
        self.cache.update((p, x) for p, x in learnt.items() if len(p) <= LONGEST_KEPT)
        return out


def single_threaded() -> None:
    """A Spark task has one core; the library would start a thread for each core of the machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def tokenizer_text(path: str) -> str:
    """A tokenizer file's JSON, read on the driver; workers get it with their task."""
    return Path(path).read_text(encoding="utf-8")


def text_encoder(model: str, words: bool = False) -> PieceEncoder:
    """The worker's encoder for a tokenizer's JSON; it stays between tasks."""
    key = (zlib.crc32(model.encode()), len(model), words)
    if key not in _ENCODERS:
        single_threaded()
        from tokenizers import Tokenizer

        _ENCODERS[key] = PieceEncoder(Tokenizer.from_str(model), words)
    return _ENCODERS[key]
