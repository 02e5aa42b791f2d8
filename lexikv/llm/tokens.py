"""Token ids of whole texts by a public tokenizer file, as little-endian uint32.

Texts are cut where no token can span: between white space and what precedes
it, and between a Latin word and its punctuation.  Each distinct chunk is
encoded once by the tokenizers library and then kept, up to a number of bytes,
so that the common words of a corpus cost a dictionary look-up.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re

import numpy as np

_KEEP_BYTES = 160 << 20  # of chunks and their ids, about, as Python objects
_SPAN = 1 << 18  # characters of a text that are cut into chunks at once
_BLANK_BETWEEN_LETTERS = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: White space for one of the regular-expression dialects only, or the start of a special token: such texts are encoded whole.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "᠎", "​", "﻿", "<|")
#: A word of Latin letters alone is a chunk without the ASCII punctuation that follows it, where no token can span either.
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\s!-/:-@\[-`{-~]|\Z)"
_BYTE_LEVEL, _WORD_LEVEL = re.compile(rf" ?{_WORD}| ?\S+|\s+(?!\S)|\s+"), re.compile(rf"{_WORD}|\S+")
_LATIN_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LATIN_1 = " ".join(chr(c) for c in range(0xA1, 0x100)) + " A B C D E F G H I J K L M N O P Q R S T U V W X Y Z"


def _size(chunks: dict[str, bytes] | set[str]) -> int:
    """Bytes that chunks and their ids take as Python objects, about."""
    return 200 * len(chunks) + 2 * sum(map(len, chunks))


class TokenIds:
    """``ids(texts)`` gives the bytes of each text's ids; made once per Python worker."""

    _made: dict[str, TokenIds] = {}

    @classmethod
    def of(cls, path: str) -> TokenIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spaces = self._encode("a \n b") != self._encode("a b")
        self._find = (_BYTE_LEVEL if spaces else _WORD_LEVEL).findall
        # a chunk of its own between any two chunks, and its ids
        self._mark = "\n" if spaces else " \x01 "
        self._mark_ids = self._encode(self._mark)
        self._lower = self._encode(_LATIN_1) == self._encode(_LATIN_1.lower())  # case doesn't matter
        self._letters = self._letter_table()
        self._kept: dict[str, bytes] = {}
        self._kept_bytes = 0

    def _letter_table(self) -> dict[int, str]:
        """What the tokenizer's model gets for each Latin letter, and for the blank before a word.

        A Latin word is one piece for the model, which can then be asked
        directly.  Empty where that would give other ids than the tokenizer.
        """
        letters = [c for c in map(chr, range(0x41, 0x100)) if _LATIN_WORD.fullmatch(c) and not (self._lower and c.isupper())]
        split = self.tokenizer.pre_tokenizer
        if split is None:
            return {}
        table = {ord(c): "".join(piece for piece, _ in split.pre_tokenize_str(c)) for c in letters}
        if self._find.__self__ is _BYTE_LEVEL:
            table[ord(" ")] = "".join(piece for piece, _ in split.pre_tokenize_str(" a"))[:-1]
        words = [*letters, "".join(letters), "".join(reversed(letters)), "the", "naïve", "straße"]
        words += [" " + w for w in words if ord(" ") in table]
        return table if all(self._model_ids(w.translate(table)) == self._encode(w) for w in words) else {}

    def _model_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _cut(self, text: str) -> list[str]:
        if self._lower:
            with contextlib.suppress(UnicodeEncodeError):  # beyond Latin-1, lower-casing is the tokenizer's own
                text.encode("latin-1")
                text = text.lower()
        return self._find(text)

    def _learn_words(self, words: list[str]) -> None:
        """Encode new Latin words by the tokenizer's model alone."""
        tokenize, letters = self.tokenizer.model.tokenize, self._letters
        ids, cuts = [], [0]
        for w in words:
            ids += [t.id for t in tokenize(w.translate(letters))]
            cuts.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        for w, a, b in zip(words, cuts, cuts[1:], strict=False):
            self._kept[w] = data[a:b]

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks in one call, parted by marks."""
        if len(self._mark_ids) == 1:
            ids = np.array(self._encode(self._mark.join(chunks)), "<u4")
            cuts = np.flatnonzero(ids == self._mark_ids[0])
            if len(cuts) == len(chunks) - 1:
                data, a = ids.tobytes(), 0
                for chunk, b in zip(chunks, [*(4 * cuts).tolist(), len(data)], strict=True):
                    self._kept[chunk] = data[a:b]
                    a = b + 4
                return
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self._kept[chunk] = np.array(e.ids, "<u4").tobytes()

    def _spans(self, text: str) -> list[str]:
        """``text`` in parts of about ``_SPAN`` characters, cut before a blank between two ASCII letters, where every dialect cuts."""
        parts, a = [], 0
        while len(text) - a > 2 * _SPAN and (cut := _BLANK_BETWEEN_LETTERS.search(text, a + _SPAN)):
            parts.append(text[a : cut.start()])
            a = cut.start()
        return [*parts, text[a:]]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; texts should be a few MB together, or one, which is encoded in parts."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > 2 * _SPAN:
            return [b"".join(self._ids([part])[0] for part in self._spans(texts[0]))]
        return self._ids(texts)

    def rest(self) -> None:
        """Keep two fifths of what may be kept: the chunks learned first, mostly the commonest.

        For the end of a partition, as a worker lives on idle.
        """
        if self._kept_bytes > _KEEP_BYTES * 2 // 5:
            n = len(self._kept) * (_KEEP_BYTES * 2 // 5) // self._kept_bytes
            self._kept = dict(itertools.islice(self._kept.items(), n))
            self._kept_bytes = _size(self._kept)

    def _ids(self, texts: list[str | None]) -> list[bytes]:
        whole = {i: np.array(self._encode(t), "<u4").tobytes() for i, t in enumerate(texts) if t and any(x in t for x in _WHOLE)}
        chunks = [self._cut(t) if t and i not in whole else () for i, t in enumerate(texts)]
        if self._kept_bytes > _KEEP_BYTES:
            self.rest()
        kept = self._kept
        new = set().union(*chunks).difference(kept)
        blank = {c for c in new if c.isspace()}
        # in a tokenizer that lower-cases, words were lowered where that is safe; others go the long way
        words = [c for c in new if _LATIN_WORD.fullmatch(c) and not (self._lower and (c[0] == " " or c != c.lower()))] if self._letters else []
        self._learn_words(words)
        others = new.difference(blank, words)
        if others:
            self._learn(list(others))
        for c in blank:  # alone, as a mark beside it would join it
            kept[c] = np.array(self._encode(c), "<u4").tobytes()
        self._kept_bytes += _size(new)
        return [whole[i] if i in whole else b"".join(map(kept.__getitem__, cs)) for i, cs in enumerate(chunks)]
