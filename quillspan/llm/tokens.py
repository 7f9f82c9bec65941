"""Token ids of whole texts by a whole-token shortcut.

The tokenizer never merges across white space, and treats each of its own pieces
(pre-tokens) apart from the others. So a text is its pre-tokens in order, and three facts
make most of them cheap:

* offline, every string of the vocabulary that ends a word is given to the library
  alone; those that come back as their own single id are proven whole tokens;
* a pre-token that is a proven string is that one id, without any merging;
* only the rest is merged, by the library's model, and remembered by each worker.

That holds for words of visible ASCII and Latin-1 letters, whose normal form, lower case and classes
are plain; they are cut into pre-tokens all at once. Words with any other character, or with the start of a special token's text,
go to the library whole, so its normalisation and its special tokens hold as they are.

The tokenizer's file travels as a broadcast value, about 3 MB whatever the data; it is
never copied into the repository, and its path is a parameter.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import attrgetter

from pyspark import Broadcast
from pyspark.sql import SparkSession

from quillspan.llm.common import let_workers_import

#: Strings in each of a worker's two memories; when the newer one is full, the older one is dropped for it.
MEMORY_WORDS = 400_000
#: Pre-tokens looked up at a time.
CHUNK_WORDS = 50_000

# How this tokenizer cuts lower-case text of visible ASCII and Latin-1 letters, and what that is in any case.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t-\r]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_ODD = r"[^!-~À-ÖØ-öø-ÿ \t-\r]"
_PLAIN_BYTES = bytes([*range(0x21, 0x7F), *b" \t\n\v\f\r"])
_WORD_END = "</w>"
_id = attrgetter("id")


def _library(json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json)


def _bytewise():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=False)


def prove_whole_tokens(json: str) -> dict[str, int]:
    """ASCII strings that the tokenizer, given them alone, encodes as one token."""
    tokenizer = _library(json)
    ends = {k.removesuffix(_WORD_END): v for k, v in tokenizer.get_vocab(with_added_tokens=False).items() if k.endswith(_WORD_END)}
    strings = [s for s in ends if s.isascii() and _PRE_TOKEN.fullmatch(s)]
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return {s: ends[s] for s, e in zip(strings, encoded) if e.ids == [ends[s]]}


class Words:
    """Looks up values of a text's ids, such as their number, piece by piece: pre-tokens, and words that are not plain."""

    def __init__(self, json: str, proven: dict[str, int], value: Callable[[list[int]], object]):
        self.library, self.value = _library(json), value
        self.proven = {s: value([i]) for s, i in proven.items()}
        bytewise = _bytewise()
        plain = [chr(c) for c in range(256) if _PLAIN.fullmatch(chr(c))]
        #: How the model writes each character: by the bytes of its UTF-8.
        self.written = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in plain}
        self.special = sorted({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        odd = "|".join([_ODD, *map(re.escape, self.special)])
        self.odd, self.odd_word = re.compile(odd), re.compile(rf"(?<![^ \t-\r])([^ \t-\r]*(?:{odd})[^ \t-\r]*)")
        self.known: dict[str, object] = dict(self.proven)
        self.older: dict[str, object] = {}

    def values(self, texts: Iterable[bytes | None]) -> Iterator[list]:
        """For each text the values of its pieces, in order. White space is that of ASCII here; any other is inside words."""
        chunk, size = [], 0
        for text in texts:
            chunk.append(self._pieces(text) if text else [])
            size += len(chunk[-1])
            if size >= CHUNK_WORDS:
                yield from self._found(chunk)
                chunk, size = [], 0
        yield from self._found(chunk)

    def _pieces(self, raw: bytes) -> list[str]:
        """Pre-tokens of plain words, and whole words of any other kind with a blank in front."""
        text = raw.decode("utf-8", "replace")
        plain = not raw.translate(None, _PLAIN_BYTES) and not any(s in text for s in self.special)
        if plain or not self.odd.search(text):
            return _PRE_TOKEN.findall(text.lower())
        pieces = []
        for k, part in enumerate(self.odd_word.split(text)):
            pieces += [f" {part}"] if k % 2 else _PRE_TOKEN.findall(part.lower())
        return pieces

    def _found(self, chunk: list[list[str]]) -> Iterator[list]:
        if len(self.known) > MEMORY_WORDS:
            self.known, self.older = dict(self.proven), self.known
        new = set().union(*chunk).difference(self.known)
        remembered = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in remembered)
        self._learn(new.difference(remembered))
        find = self.known.__getitem__
        return (list(map(find, pieces)) for pieces in chunk)

    def _learn(self, pieces: set[str]) -> None:
        merge, odd = self.library.model.tokenize, []
        for piece in pieces:
            if piece[0] == " ":
                odd.append(piece)
            else:
                self.known[piece] = self.value(list(map(_id, merge(piece.translate(self.written)))))
        for piece, e in zip(odd, self.library.encode_batch_fast([p[1:] for p in odd], add_special_tokens=False)):
            self.known[piece] = self.value(e.ids)


_ID_TYPE = "I" if array("I").itemsize == 4 else "L"
_SWAPPED = array("H", [1]).tobytes() == b"\0\1"


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    numbers = array(_ID_TYPE, ids)
    if _SWAPPED:
        numbers.byteswap()
    return numbers.tobytes()


_workers: dict[tuple, Words] = {}


def words_of(shared: Broadcast, value: Callable[[list[int]], object]) -> Words:
    """This Python worker's lookup, made once and kept for later tasks."""
    json, proven = shared.value
    key = (len(json), hash(json), value.__name__)
    if key not in _workers:
        _workers[key] = Words(json, proven, value)
    return _workers[key]


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer at ``path`` and its proven strings, for the executors."""
    let_workers_import(spark)
    with open(path, encoding="utf-8") as file:
        json = file.read()
    return spark.sparkContext.broadcast((json, prove_whole_tokens(json)))
