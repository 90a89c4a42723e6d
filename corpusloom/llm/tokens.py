"""Texts to token ids with a public tokenizer, remembering the ids of pieces seen before.

A text is cut where the tokenizer's own rules always start a new token, so the ids of a text
are those of its pieces one after the other. Frequent pieces are looked up; new ones go to the
tokenizers library, many at a time.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

from corpusloom.llm.common import kept_by_worker

#: Pieces a worker remembers, about 200 MB. Beyond it the newer half is forgotten.
MEMORY = 1_000_000
_CHUNK_CHARS = 1 << 20
_BATCH = 4096

#: White space that the cutting patterns below don't know; such texts are encoded whole.
_RARE_SPACE = re.compile(
    "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Where white space is dropped, pieces end at any of it.
_DROPPED = re.compile(r"[^ \n]+")
#: Where a blank belongs to the word after it: a blank and a word, a line break between two
#: words, or a longer run of white space with the word after it.
_KEPT = re.compile(r"[ \n]{2,}[^ \n]*| ?[^ \n]+|[ \n]")


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        kind = self._kind(rules)
        self.cut = {"dropped": _DROPPED, "kept": _KEPT}.get(kind)
        self.rare = _RARE_SPACE if kind == "kept" else None
        steps = (rules.get("normalizer") or {}).get("normalizers") or []
        self.lower = kind == "dropped" and any(s.get("type") == "Lowercase" for s in steps)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _kind(rules: dict) -> str:
        """Which cutting is exact for the tokenizer's rules; "whole" when neither is known to be."""
        steps = rules.get("pre_tokenizer") or {}
        plain = not any(t["lstrip"] or t["rstrip"] for t in rules.get("added_tokens", []))
        if plain and rules.get("normalizer") is None and steps.get("type") == "ByteLevel":
            return "kept" if steps.get("use_regex") and not steps.get("add_prefix_space") else "whole"
        first = (steps.get("pretokenizers") or [{}])[0]
        if plain and first.get("type") == "Split" and first.get("invert") and (
                first.get("behavior") == "Removed"):
            return "dropped"
        return "whole"

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        chunk: list[str] = []
        size = 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= _CHUNK_CHARS:
                out += self._chunk(chunk)
                chunk, size = [], 0
        return out + self._chunk(chunk) if chunk else out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return [self._whole(text) for text in texts]
        rare = self.rare
        if self.lower:
            # The tokenizer does the same to ASCII; "<|" may begin a token that keeps its case.
            texts = [t.lower() if t.isascii() and "<|" not in t else t for t in texts]
        pieces = [None if rare and rare.search(t) else self.cut.findall(t) for t in texts]
        fresh = set().union(*(p for p in pieces if p)).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > MEMORY:
                for piece in list(self.known)[MEMORY // 2:]:
                    del self.known[piece]
                fresh = set().union(*(p for p in pieces if p)).difference(self.known)
            self._learn(list(fresh))
        get = self.known.__getitem__
        return [self._whole(t) if p is None else b"".join(map(get, p))
                for t, p in zip(texts, pieces)]

    def _learn(self, fresh: list[str]) -> None:
        for at in range(0, len(fresh), _BATCH):
            batch = fresh[at:at + _BATCH]
            self.known.update(zip(batch, self._joined(batch) or self._apart(batch)))

    def _apart(self, pieces: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        made = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array(code, one.ids).tobytes() for one in made]

    def _joined(self, pieces: list[str]) -> list[bytes] | None:
        """The ids of all pieces from one text of them, which takes two thirds of the time.

        Only where white space is dropped, as between them in their own texts; where a token began
        tells whose it is. None when places in the text do not rise.
        """
        if self.cut is not _DROPPED:
            return None
        made = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        places = np.array(made.offsets, np.int64).reshape(-1, 2)[:, 0]
        if (np.diff(places) < 0).any():
            return None
        starts = np.cumsum([0, *(len(piece) + 1 for piece in pieces)])
        cut = (np.searchsorted(places, starts) * self.dtype.itemsize).tolist()
        ids = np.array(made.ids, self.dtype).tobytes()
        return [ids[i:j] for i, j in zip(cut, cut[1:])]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()


_encoders: dict[str, PieceEncoder] = kept_by_worker()


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def public_path(name: str) -> Callable[[], str]:
    """The place of a public tokenizer's file, looked up where it is needed."""

    def find() -> str:
        import public_tokenizers
        return public_tokenizers.path(name)

    return find
