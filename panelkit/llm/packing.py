"""Packing by power-of-two decomposition: no sequence crosses documents, none of them is padded.

The ids of a document are cut into pieces of `max_tokens` and then, from the binary digits of the
rest, into pieces of falling powers of two. Each piece is a sequence of its own; sequences of equal
length form a bucket from which batches are drawn.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import documents_of

MAX_TOKENS, END_ID = 2048, 1
#: Words that a worker remembers the ids of; beyond that it starts anew, which bounds its memory.
REMEMBERED = 500_000
#: Marks that are tokens apart from the letters before them; up to four of them are cut off.
MARKS = "!#$%&*,.:;?"
#: Longer words are not remembered, so that the memory is bounded in bytes as well.
LONGEST = 64
#: Bytes of ids that are sent on at once.
SENT = 8_000_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space, by way of the ids of their words.

    As no token crosses white space, a text has the ids of its words one after another; each different word
    is tokenized once. A run of marks (MARKS) at the end of a word of letters is cut from it before the merges, so both
    have ids of their own. Words of letters that are normalised as they stand (ASCII and other Latin ones after
    lower-casing) go to the merges directly, and all others through the whole tokenizer. Texts are cut at
    blanks and line ends; other white space goes to the tokenizer with its word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.memory: dict[str, bytes] = {}
        self.marks = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [_packed(x.ids) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _merge(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return _packed([x.id for x in self.model.tokenize(word)])

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        memory, marks, new, rest = self.memory, self.marks, {}, []
        for w in words:
            stem = w.rstrip(MARKS)
            mark = w[len(stem) :]
            if stem.isascii():
                stem = stem.lower()
            else:
                # up to U+024F, but for one letter, small letters are the same everywhere; others stay as they are
                low = stem.lower() if max(stem) < "\u0250" and "\u0130" not in stem else stem
                stem = low if low == low.lower() and is_normalized("NFC", stem) and is_normalized("NFC", low) else ""
            if not stem.isalpha() or len(mark) > 4:
                rest.append(w)
                continue
            if (of_mark := marks.get(mark)) is None:
                of_mark = marks[mark] = self._encode([mark])[0]
            if (ids := memory.get(stem) or new.get(stem)) is None:
                ids = new[stem] = self._merge(stem)
            if stem is not w:
                new[w] = ids + of_mark
        new.update(zip(rest, self._encode(rest)))
        return new

    def _remember(self, new: dict[str, bytes]) -> None:
        """Keep the new words within the bounds; the memory starts anew where they do not fit."""
        if max(map(len, new), default=0) > LONGEST:
            new = {w: ids for w, ids in new.items() if len(w) <= LONGEST}
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
        if len(new) <= REMEMBERED:
            self.memory.update(new)

    def ids_of(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null has none."""
        for i in range(0, len(texts), 200):
            cut = [(t or "").replace("\n", " ").split(" ") for t in texts[i : i + 200]]
            found = [list(map(self.memory.get, words)) for words in cut]
            if missing := {w for words, ids in zip(cut, found) if None in ids for w, x in zip(words, ids) if x is None}:
                new = self._learn(missing)
                found = [[new[w] if x is None else x for w, x in zip(words, ids)] for words, ids in zip(cut, found)]
                self._remember(new)
            for ids in found:
                yield b"".join(ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """The tokenizer of a file; a worker loads it once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces_of(n: int, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences first, then falling powers of two."""
    out = [(s, max_tokens) for s in range(0, n - n % max_tokens, max_tokens)]
    start, size = n - n % max_tokens, max_tokens // 2
    while start < n:
        if n - start >= size:
            out.append((start, size))
            start += size
        size //= 2
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `ids` are the piece's ids (little-endian unsigned 32-bit); `length` names the bucket; offset is 0, as each
    piece is a sequence. max_tokens is a power of two. Null and empty texts are packed as the end id alone;
    repeated rows and rows without an id are packed one by one; an empty table gives no rows.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    fields = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_at(tokenizer_path), end_id.to_bytes(4, "little")
        for part in parts:
            names = part.column("doc_id")
            rows, starts, lengths, cuts, totals, size = [], [], [], [], [], 0

            def send() -> pa.RecordBatch:
                columns = [names.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths)), pa.array(cuts, pa.binary()), pa.array(totals, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=fields)

            for k, ids in enumerate(tokenizer.ids_of(part.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for start, length in pieces_of(n, max_tokens):
                    rows.append(k)
                    starts.append(start)
                    lengths.append(length)
                    cuts.append(ids[4 * start : 4 * (start + length)])
                    totals.append(n)
                size += len(ids)
                if size > SENT:
                    yield send()
                    rows, starts, lengths, cuts, totals, size = [], [], [], [], [], 0
            if rows:
                yield send()

    packed = documents_of(docs, id_col, text_col).mapInArrow(batches, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return packed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def piece_report(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
