"""Exact, cached encoding with a ``tokenizers`` file.

A text is cut at blanks where no pre-token can span the cut, and every distinct chunk is encoded once per worker; the
ids of the whole text are the joined ids of its chunks, so the result equals ``encode_batch`` on the whole text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker keeps, about 400 bytes each. A full cache takes no more; it starts anew after four times as many
#: misses, so it follows a change of language.
CACHED_CHUNKS = 300_000
#: Rows, and bytes of their columns, that an operator holds at once; a single longer row stays whole.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

#: Characters whose classes are beyond doubt: Latin letters, digits, signs other than the apostrophe, single line ends
#: within. A chunk of these is split as the library's patterns would.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_SIGNS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*")
_WORD = re.compile(rf"[{_LETTERS}]+")
_LEADING = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n")
_DROPPED = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(rest)}


_BYTE_CHARS = _byte_chars()
_POINTS = {",", "."}
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class _Chunks(dict):
    """Ids by chunk, made on first sight; None for a chunk whose ids depend on its neighbours."""

    def __init__(self, make):
        super().__init__()
        self.make, self.misses = make, 0

    def __missing__(self, chunk: str) -> bytes | None:
        out = self.make(chunk)
        if len(self) < CACHED_CHUNKS:
            self[chunk] = out
        else:
            self.misses += 1
            if self.misses > 4 * CACHED_CHUNKS:
                self.clear()
                self.misses = 0
        return out


class ChunkEncoder:
    """Whole texts to the little-endian unsigned 32-bit ids that the library gives them, without special tokens.

    ``special_as_text``: strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        pre, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer")
        drops = [x for x in pre.get("pretokenizers", []) if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[^\s" in x["pattern"].get("Regex", "")]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.rule = "blank leads"  # a pre-token may begin with one blank
        elif drops and parts["model"].get("end_of_word_suffix"):
            self.rule = "blanks drop"  # white space is in no pre-token
        else:
            self.rule = "whole"
        self._tokenize = self.tokenizer.model.tokenize
        self.signs: dict[str, bytes] = {}
        self.later = _Chunks(self._dropped if self.rule == "blanks drop" else self._later)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, words: Iterable[str]) -> bytes:
        """Ids of pre-tokens of plain characters, straight from the library's model."""
        return b"".join(map(self._word, words))

    def _word(self, word: str) -> bytes:
        known = self.signs.get(word)
        if known is None:
            known = _packed([t.id for t in self._tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))])
            if len(word) < 5 and len(self.signs) < 10_000:
                self.signs[word] = known
        return known

    def _later(self, chunk: str) -> bytes | None:
        """Ids of a chunk after a blank, with that blank."""
        if chunk.isascii() and chunk.isalpha():
            return _packed([t.id for t in self._tokenize("\u0120" + chunk)])
        if chunk[-1:] in _POINTS and chunk[-2:-1].isalpha():  # a sign after a letter is a pre-token of its own
            before = self.later[chunk[:-1]]
            return before and before + self._word(chunk[-1])
        if _WORD.fullmatch(chunk):
            return self._word(" " + chunk)
        if _PLAIN.fullmatch(chunk):
            return self._model(_LEADING.findall(" " + chunk))
        return None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self._whole(" " + chunk)

    def _dropped(self, chunk: str) -> bytes:
        """Ids of a chunk where blanks are in no pre-token."""
        lower = chunk.lower()
        if lower.isascii() and lower.isalpha():
            return _packed([t.id for t in self._tokenize(lower)])
        if chunk[-1:] in _POINTS and chunk[-2:-1].isalpha():
            return self.later[chunk[:-1]] + self.later[chunk[-1]]
        if _PLAIN.fullmatch(chunk) and _PLAIN.fullmatch(lower):
            return self._model(_DROPPED.findall(lower))
        return self._whole(chunk) if chunk else b""

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """A null text counts as empty."""
        if self.rule == "whole":
            return [self._whole(x or "") for x in texts]
        get = self.later.__getitem__
        if self.rule == "blanks drop":
            return [b"".join(map(get, (x or "").split(" "))) for x in texts]
        out = []
        for text in texts:
            parts = (text or "").split(" ")
            try:
                if len(parts) > 1 and not parts[0][-1:].strip():
                    raise TypeError
                out.append(self._whole(parts[0]) + b"".join(map(get, parts[1:])))
            except TypeError:  # white space beside a blank
                parts = _SAFE_BLANK.split(text)
                out.append(self._whole(parts[0]) + b"".join([get(x) or self._whole(" " + x) for x in parts[1:]]))
        return out


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder != "little":
        made.byteswap()
    return made.tobytes()


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = True) -> ChunkEncoder:
    """One per worker process and file."""
    return ChunkEncoder(path, special_as_text)


def give_up_cache() -> None:
    """Frees what this worker has learned; called by operators that need memory and no tokenizer."""
    encoder.cache_clear()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, under fixed names: other columns can't clash with what an operator adds."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def rows_of(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds at once follows neither the batch size of the session nor the texts' lengths."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            parts = [batch.slice(at, rows)]
            while parts:
                part = parts.pop()
                if part.num_rows > 1 and part.nbytes > size:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
