"""Sum-of-squares packing of documents into token windows.

A document is its tokens and then ``end_id``. Pieces of exactly ``window`` tokens fill sequences of their own. The
rest of the document goes, whole, into a partially filled sequence or a new one: of all levels h (tokens already
filled) where it fits, the one that makes the sum over levels of N(h) squared smallest, where N(h) counts the
sequences filled to h; on a tie the fullest. N is an array of one count for each level. When a task has placed its
last document, what stands in the emptiest unfinished sequences is cut to fill up the fullest ones; these keep what was placed
there. The last remainder goes into sequences of powers of two, which need no padding. So no sequence is padded.

Every task packs the documents of its input split; no rows are moved. A sequence's id holds the task's partition.

Tokens: the pre-tokenizer never joins across white space, so the tokens of a text are those of its words in turn,
and each Python worker keeps the tokens of words of up to ``CACHE_LETTERS`` characters that it has seen (from ``CACHE_WORDS`` on it
starts anew, with the words before at hand). Texts with characters that Python and the tokenizer don't agree on as white space are
encoded in one call. Words of ASCII and Latin-1 letters are cut into pre-tokens here, and the model alone is asked for these; this
saves what the tokenizer spends on normalising and on offsets. All other words, and all words of a tokenizer with other rules, are
encoded by the tokenizer.

Defined cases: a null or empty text is ``end_id`` alone; a null doc_id stays null; repeated rows are packed as often;
an empty table gives an empty result; other columns are ignored; documents longer than a window are cut.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from bytewright.plans.columns import pick
from bytewright.plans.workers import kept
from bytewright.sources.tables import table

NAME = "op9_packing"
WINDOW, END_ID, CACHE_WORDS, CACHE_LETTERS = 4096, 2, 200_000, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+").findall
#: A full stop or comma at a word's end that follows another mark, and so is no pre-token of its own.
_MARKS = re.compile(r"[.,](?<=[^a-z0-9ß-öø-ÿ\s][.,])\s").search
#: How byte-level tokenizers write the letters that are two bytes long in UTF-8.
_WRITTEN = {n: "Ã" + (chr(b) if b > 0xA0 and b != 0xAD else chr(323 if b == 0xAD else b + 162)) for n in range(0xC0, 0x100) for b in (n - 0x40,)}
#: The settings under which ``_PARTS`` of a word in lower case are its pre-tokens.
_KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class Ids(dict):
    """Token ids of words, and by these of texts, as little-endian 32-bit bytes. One of these serves all tasks of a Python worker."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.tokenize = self.encoder.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.encoder.get_vocab_size())]
        self.by_parts = tuple(x and json.loads(x.__getstate__()) for x in (self.encoder.normalizer, self.encoder.pre_tokenizer)) == _KNOWN
        self.older: dict[str, bytes] = {}  # the words before these: those met again move over, the others are forgotten

    @classmethod
    def at(cls, path: str) -> Ids:
        return kept((NAME, path), lambda: cls(path))

    def _encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join([self.four[t.id] for t in self.tokenize(part if part.isascii() else part.translate(_WRITTEN))])

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if not self.by_parts or not (letters := word.isascii() and word.isalpha()) and not _SIMPLE(word):
                found = self._encode(word)
            elif letters:
                found = self._part(word.lower())
            elif len(parts := _PARTS(word.lower())) == 1:
                found = self._part(parts[0])
            else:
                found = b"".join([self.get(p) or self.older.get(p) or self._part(p) for p in parts])
        if len(word) <= CACHE_LETTERS:
            self[word] = found
        return found

    def _words(self, text: str) -> list[str]:
        """What, encoded word by word, has the ids of the text; in lower case where that changes no token: in Latin-1, composing
        characters doesn't interfere with case. Full stops and commas are words where they are pre-tokens."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        text = text.lower()
        if self.by_parts and not _MARKS(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return text.split()

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        word = self.__getitem__
        for t in texts:
            if len(self) > CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            yield self._encode(t) if t and any(map(t.__contains__, _ODD)) else b"".join(map(word, self._words(t or "")))


class Packer:
    """Places one document after another; ``add`` and ``finish`` give the pieces of sequences that are complete."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)  # N(h); N(0) and N(window) stay 0
        self.open: dict[int, list[list]] = defaultdict(list)  # level -> sequences, each a list of pieces
        self.cut = 0  # tokens that ``finish`` has moved

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _level(self, n: int) -> int:
        """Where ``n`` tokens go: change of the sum of squares, N(h + n) up by one and N(h) down by one."""
        levels = self.window - n
        change = 2 * (self.counts[n : self.window + 1] - self.counts[: levels + 1]) + 2
        change[0] -= 1
        change[levels] -= 2 * self.counts[self.window] + 1
        if levels == 0:
            return 0
        usable = self.counts[: levels + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return levels - int(np.argmin(change[::-1]))

    def _rows(self, pieces: list) -> Iterator[tuple]:
        number, offset = self._new(), 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, number, offset
            offset += n

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, size = len(ids) // 4, self.window
        for start in range(0, total - size + 1, size):
            yield from self._rows([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
        start = total // size * size
        if n := total - start:
            level = self._level(n)
            pieces = self.open[level].pop() if level else []
            self.counts[level] -= level > 0
            pieces.append((doc_id, start, ids[4 * start :], total))
            if level + n == size:
                yield from self._rows(pieces)
            else:
                self.open[level + n].append(pieces)
                self.counts[level + n] += 1

    def finish(self) -> Iterator[tuple]:
        bins = deque((level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level])
        self.open.clear()
        self.counts[:] = 0
        loose: list = []  # pieces of emptiest sequences, the next one last

        def taken(room: int) -> Iterator[list]:
            while room and loose:
                doc_id, start, ids, total = loose.pop()
                n = min(room, len(ids) // 4)
                yield doc_id, start, ids[: 4 * n], total
                if 4 * n < len(ids):
                    loose.append((doc_id, start + n, ids[4 * n :], total))
                room -= n

        held = 0
        while bins:
            level, pieces = bins.popleft()
            while held < self.window - level and bins:
                more, emptiest = bins.pop()
                loose[:0] = emptiest
                held += more
            if held < self.window - level:
                loose[:0] = pieces
                held += level
                break
            pieces = [*pieces, *taken(self.window - level)]
            held -= self.window - level
            self.cut += self.window - level
            yield from self._rows(pieces)
        self.cut += held
        for size in [self.window] * (held // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if held % self.window >> b & 1]:
            yield from self._rows(list(taken(size)))


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``docs`` has doc_id and text; returns a row for each piece, by ``SCHEMA``. ``tokenizer`` is a file that each
    executor can read."""
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = Ids.at(tokenizer), Packer(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), ids.of(part.column("text").to_pylist()), strict=True):
                    rows.extend(packer.add(doc_id, found + end))
                yield _batches(rows)
        yield _batches(list(packer.finish()))

    return pick(docs, "doc_id", "text").mapInArrow(pack, SCHEMA)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens; a row for each piece."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
