"""Public tokenizers inside tasks: a vocabulary file goes to the tasks once, and each chunk of text is encoded once a worker.

Texts are cut at white space that neither tokenizer lets a token cross, so a text's tokens are its chunks' tokens, one
after the other.  A batch's chunks are told apart by Arrow, so a worker looks up each different one once a batch; it remembers
their results up to MEMO_BYTES and starts anew beyond that.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a vocabulary file that may be broadcast.
VOCABULARY_BYTES = 64 << 20
#: Bytes of chunks and results that a worker remembers, about.
MEMO_BYTES = 160 << 20

#: White space is dropped and ends a word: every space cuts.
AT_SPACES = re.compile(" ")
#: A token may begin with a space and never goes on over one: single spaces between other characters cut, and stay.
BEFORE_SPACES = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")


BESIDE_SPACES = re.compile(r" [\s\u180e]|[\s\u180e] ")


def simply_spaced(text: str) -> bool:
    """Of a text that begins with a space: every space cuts, as none has white space beside it or ends the text."""
    return text[-1] != " " and not BESIDE_SPACES.search(text)


def spaced_chunks(text: str) -> list[str]:
    """BEFORE_SPACES.split(text) of a text that begins with a space; simpler where no space has white space beside it."""
    return [f" {p}" for p in text[1:].split(" ")] if simply_spaced(text) else BEFORE_SPACES.split(text)


def vocabulary_path(name: str) -> str:
    """Where the installed public tokenizers have a file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_file(spark: SparkSession, name: str):
    """A broadcast of a vocabulary file's bytes, of a checked size, so that executors need no copy of it."""
    path = vocabulary_path(name)
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class Memo:
    """chunk -> result, as bytes; what is missing in a list of chunks is worked out by `encode` (list of chunks -> list of results).

    Two generations: when one is full the other goes, so chunks that keep coming stay."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = MEMO_BYTES // 2):
        self.encode, self.limit, self.size = encode, limit, 0
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def results(self, chunks: list[str]) -> list[bytes]:
        """A result for each of the chunks, which differ."""
        if self.size > self.limit:
            self.before, self.now, self.size = self.now, {}, 0
        now, before = self.now, self.before
        out: list = [*map(now.get, chunks)]
        missing = [i for i, r in enumerate(out) if r is None]
        unknown = []
        for i in missing:
            if (r := before.get(chunks[i])) is None:
                unknown.append(i)
            else:
                out[i] = now[chunks[i]] = r
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            for i, r in zip(part, self.encode([chunks[i] for i in part]), strict=True):
                out[i] = now[chunks[i]] = r
        self.size += sum([180 + len(chunks[i]) + len(out[i]) for i in missing])
        return out


def different(pieces: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different strings among pieces, and which of them each piece is."""
    found = pieces.dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


class Words:
    """Ids of chunks through a tokenizer's parts, its model asked once for each different word of MOST.

    plain_words finds the words of ASCII and the letters of Latin-1 (PLAIN) as the tokenizer's pre-tokenizer does (tests hold it); other
    chunks go through the normalizer and the pre-tokenizer, and chunks with special tokens, or all where plain_words is None, through the
    whole tokenizer."""

    MOST = 300_000

    def __init__(self, tokenizer, plain_words: re.Pattern | None, lower: bool):
        self.tokenizer, self.plain_words, self.lower = tokenizer, plain_words, lower
        self.model, self.normalizer, self.splitter = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
        self.written = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[str, list[int]] = {}
        self.other: dict[str, list[int]] = {}  # by the byte alphabet's characters

    def ids(self, chunk: str) -> list[int]:
        if self.plain_words is None or "<|" in chunk:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        if chunk.isascii() or PLAIN.fullmatch(chunk):
            text = chunk.lower() if self.lower else chunk
            words = [text] if text.isalpha() or (not self.lower and text[:1] == " " and text[1:].isalpha()) else self.plain_words.findall(text)
            known, written = self.known, False
        else:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk) if self.normalizer else chunk)]
            known, written = self.other, True
        if len(known) > self.MOST:
            known.clear()
        out: list[int] = []
        for w in words:
            if (ids := known.get(w)) is None:
                plain = written or (w.isascii() and w.isalpha())  # these letters are written as they are
                ids = known[w] = [t.id for t in self.model.tokenize(w if plain else w.encode().decode("latin-1").translate(self.written))]
            out += ids
        return out


#: ASCII and the letters of Latin-1: each is lower-cased by itself, and NFC changes none of them.
PLAIN = re.compile(r"[\0-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
#: Fixed: how the two public word tokenizers cut, and the same over PLAIN.
CUTS = {
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xC0-\xFF]+|[0-9]|[^\t-\r a-z0-9\xC0-\xFF]+"),
    "byte level": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xC0-\xFF]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9\xC0-\xFF]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
}


def words_of(data: bytes, tokenizer) -> Words:
    """Words for a tokenizer's file; with plain_words only where the file says that it cuts as one of the CUTS."""
    spec = json.loads(data)
    cut, steps = spec.get("pre_tokenizer") or {}, [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and spec.get("normalizer") is None:
        return Words(tokenizer, CUTS["byte level"], False)
    first, *rest = cut.get("pretokenizers", [{}])
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and [r["type"] for r in rest] == ["ByteLevel"]:
        return Words(tokenizer, CUTS.get(first["pattern"].get("Regex")), True)
    return Words(tokenizer, None, False)


def loaded(name: str, make: Callable[..., Any], *files: bytes, kept: dict = {}) -> Any:  # noqa: B006
    """make(*files), kept by the worker for its next tasks, one result a name."""
    key = tuple((len(f), zlib.crc32(f)) for f in files)
    if kept.get(name, (None,))[0] != key:
        kept[name] = key, make(*files)
    return kept[name][1]


def word_tokenizer(data: bytes):
    """A `tokenizers` tokenizer from its file's bytes, on one thread, without truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: printable ones of Latin-1 as themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
