"""Byte-level BPE with word ends: merges by a priority queue over a linked list of symbols, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm._common import spans, table

#: Bytes that the remembered words, and runs between blanks, of a worker may take with their ids: the first it meets; others
#: are merged anew, which bounds its memory. A run is a word with signs around it, so words repeat more often, and get
#: the larger part. A query keeps them from task to task; the pipeline, whose other stages need the memory, keeps fewer
#: and forgets them at the end of a task.
REMEMBERED, IN_PIPELINE = (96 << 20, 24 << 20), (16 << 20, 8 << 20)
#: What Python adds to a remembered string and its ids.
OVERHEAD = 180
CHARS_AT_ONCE = 500_000


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Tokenizer:
    """What a tokenizer file (JSON text) says, ready to encode: a vocabulary, ranked merges, a word pattern."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: s for s, i in (self.ids | self.special).items()}
        self.strings = [named.get(i, "") for i in range(max(named) + 1)]
        known = [(a, b) for a, b in model["merges"] if a in self.ids and b in self.ids and a + b in self.ids]
        self.made = [self.ids[a + b] for a, b in known]
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(known):
            self.rank.setdefault((self.ids[a], self.ids[b]), rank)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        signs = byte_signs()
        self.inner = [self.ids.get(s) for s in signs]
        self.final = [self.ids.get(s + self.suffix) for s in signs]
        self.forget(REMEMBERED)

    def forget(self, budget: tuple[int, int]) -> None:
        """Forget all words and runs, and have ``budget`` bytes for either from now on."""
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.left = {id(self.words): budget[0], id(self.runs): budget[1]}

    def _remember(self, known: dict[str, bytes], text: str, packed: bytes) -> None:
        size = OVERHEAD + len(text) + len(packed)
        if len(text) <= 64 and size <= self.left[id(known)]:
            known[text] = packed
            self.left[id(known)] -= size

    def merge(self, word: str) -> list[int]:
        """The ids of one word.

        Symbols form a doubly linked list; candidate merges wait in a heap by rank, then position. An entry whose
        symbols have changed since it was pushed is stale and skipped.
        """
        raw = word.encode("utf-8", "surrogatepass")
        symbol = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        symbol = [s for s in symbol if s is not None]
        n, rank, made = len(symbol), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, pair in enumerate(zip(symbol, symbol[1:], strict=False)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j, a = after[i], symbol[i]
            if j >= n or a < 0 or rank((a, symbol[j])) != r:
                continue
            symbol[i] = a = made[r]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((a, symbol[k]))) is not None:
                    heapq.heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank((symbol[h], a))) is not None:
                heapq.heappush(heap, r * n + h)
        return [s for s in symbol if s >= 0]

    def _run(self, run: str) -> bytes:
        """The ids of a run of signs without a blank, which may hold several words."""
        out = []
        for word in self.word.findall(run):
            if (packed := self.words.get(word)) is None:
                ids = self.merge(word)
                packed = struct.pack(f"<{len(ids)}I", *ids)
                self._remember(self.words, word, packed)
            out.append(packed)
        packed = b"".join(out)
        self._remember(self.runs, run, packed)
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts = self.cut.split(text) if self.cut else [text]
        out, known = [], self.runs
        for part in parts:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                # blanks are part of no word, so folding them would change nothing; sigma is lowered by itself, not by its place
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [known[r] if r in known else self._run(r) for r in plain.split(" ")]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The vocabulary strings of the ids with a blank between, as the file names no decoder of its own."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ready: dict[str, Tokenizer] = {}


def _tokenizer(source: str) -> Tokenizer:
    """One tokenizer a worker process and file, kept between tasks."""
    name = hashlib.sha256(source.encode()).hexdigest()
    if name not in _ready:
        _ready.clear()
        _ready[name] = Tokenizer(source)
    return _ready[name]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Each row of ``docs`` without its text, plus ids (binary) and decoded.

    The driver reads the tokenizer file at ``path`` and broadcasts its text, whose size the vocabulary fixes. A null
    text is an empty one and has no tokens. Special tokens spelt out in a text become their ids, as the tokenizers
    library has it. Texts are encoded whole; a caller's columns named ids or decoded are replaced.
    """
    return _mapped(docs, path, "ids binary, decoded string", lambda ids, decoded: (ids, decoded))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The same, but only n_tokens and the digests of ids and decoded text, made where the text is."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    row = lambda ids, decoded: (len(ids) // 4, sha(ids), sha(decoded.encode("utf-8", "surrogatepass")))
    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _mapped(docs: DataFrame, path: str, fields: str, made, budget: tuple[int, int] | None = None) -> DataFrame:
    """Texts leave their Arrow batch a few at a time, so a batch is never held twice. ``budget``: what a task may remember
    and forgets at its end; without one a worker remembers from task to task."""
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    added = [(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]
    docs = docs.drop(*[n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(source.value)
        if budget:
            tokenizer.forget(budget)
        for batch in batches:
            texts, kept = batch.column("text"), batch.drop_columns(["text"])
            for lo, hi in spans(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), CHARS_AT_ONCE):
                rows = []
                for i in range(lo, hi):
                    ids = tokenizer.encode(texts[i].as_py() or "")
                    rows.append(made(ids, tokenizer.decode(ids)))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), added, strict=True)]
                yield pa.RecordBatch.from_arrays(kept.slice(lo, hi - lo).columns + columns, kept.schema.names + [n for n, _ in added])
            pa.default_memory_pool().release_unused()
        if budget:
            tokenizer.forget(REMEMBERED)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, ", ".join(x for x in (kept, fields) if x))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens in place of its text: ids (little-endian unsigned 32-bit numbers), n_tokens, and the
    digests of ids and decoded text.

    The caller's other columns stay; those named like the new ones are replaced. A null or empty text has no tokens;
    texts are encoded whole, however long; repeated rows stay apart; no rows give none.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()
    row = lambda ids, decoded: (ids, len(ids) // 4, sha(ids), sha(decoded.encode("utf-8", "surrogatepass")))
    return _mapped(docs, vocabulary_path(), "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string", row, IN_PIPELINE)
