"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the special strings, the rest by the vocabulary's pre-tokeniser; in each piece
the lowest-ranked adjacent pair is popped from a heap and merged in a linked list until none is
left. The count is the initial symbols minus the merges; identifiers are never made. Counts of
pieces are kept in a table of bounded size per worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker keeps before it starts anew.
MEMO = 400_000

#: The byte-level pre-tokeniser's pattern, and the same for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: printable Latin-1
    bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Irregular(Exception):
    """A space stands before another white space: the text is cut by the pattern as a whole."""


class _Chunks(dict):
    """Tokens of what stands between two spaces, with the space before it."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[0].isspace():
            raise _Irregular
        n = self.counter.pieces(" " + chunk)
        if len(chunk) <= 48 and "\n" not in chunk:  # others seldom come again
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = n
        return n


def check_settings(spec: dict) -> None:
    """Raises ValueError for a vocabulary file that this module would count otherwise than its
    library: it must be byte-level BPE with the pre-tokeniser's pattern, without prefix space,
    normaliser, dropout or word-end marks, and its added tokens plain strings."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    faults = [
        (spec.get("normalizer") is not None, "a normalizer"),
        (pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or bool(pre.get("add_prefix_space")), "another pre-tokenizer than plain ByteLevel"),
        (model.get("type", "BPE") != "BPE" or bool(model.get("ignore_merges")), "another model than plain BPE"),
        (any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")), "dropout or marks on subwords"),
        (any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")), "added tokens with flags"),
    ]
    if found := [what for bad, what in faults if bad]:
        raise ValueError(f"the vocabulary file has {', '.join(found)}")


class Counter:
    """Counts the tokens of texts as the vocabulary file's library does."""

    def __init__(self, path: str):
        import re

        import regex

        spec = json.load(open(path, encoding="utf-8"))
        check_settings(spec)
        alphabet = byte_alphabet()
        number = {c: b for b, c in alphabet.items()}  # a symbol's string to its number here
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ", 1) if isinstance(m, str) else m
            self.rank[number[a] << 20 | number[b]] = r
            self.merged.append(number.setdefault(a + b, 256 + r))
        special = [t["content"] for t in spec["added_tokens"]]
        # the leftmost special string counts first, of several at one place the longest
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut, self.cut_ascii = regex.compile(PATTERN, regex.V1).findall, re.compile(ASCII_PATTERN, re.A).findall
        # 0x1C-0x1F are white space to Python's dialect, but not to the library's
        self.odd = re.compile("[\x1c-\x1f]").search
        self.cut_odd = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"), regex.V1).findall
        self.known: dict[str, int] = {}
        self.chunks = _Chunks(self)

    def piece(self, data: bytes) -> int:
        """Symbols left of one pre-token after all merges. The heap holds rank and place in one
        number; an entry counts only while the pair at its place still has that rank."""
        n = len(data)
        if n < 2:
            return n
        get, bits = self.rank.get, n.bit_length()
        symbol = list(data)
        at = [get(a << 20 | b, -1) for a, b in zip(symbol, symbol[1:])]
        heap = [r << bits | i for i, r in enumerate(at) if r >= 0]
        if not heap:
            return n
        at.append(-1)
        before, after = list(range(-1, n - 1)), [*range(1, n), n]
        heapq.heapify(heap)
        pop, push, low, merges = heapq.heappop, heapq.heappush, (1 << bits) - 1, 0
        while heap:
            top = pop(heap)
            i, r = top & low, top >> bits
            if at[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            at[j] = -1
            s = symbol[i] = self.merged[r]
            merges += 1
            if k < n:
                before[k] = i
                r = at[i] = get(s << 20 | symbol[k], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                at[i] = -1
            h = before[i]
            if h >= 0:
                r = at[h] = get(symbol[h] << 20 | s, -1)
                if r >= 0:
                    push(heap, r << bits | h)
        return n - merges

    def pieces(self, text: str) -> int:
        known, total = self.known, 0
        for p in self.cut_odd(text) if self.odd(text) else self.cut_ascii(text) if text.isascii() else self.cut(text):
            c = known.get(p)
            if c is None:
                c = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= 48:
                    if len(known) >= MEMO:
                        known.clear()
                    known[p] = c
            total += c
        return total

    def plain(self, text: str) -> int:
        """Before a space that is followed by another character than white space, the
        pre-tokeniser always cuts, so that a text is the sum of the chunks between spaces."""
        first, *rest = text.split(" ")
        try:
            return sum(map(self.chunks.__getitem__, rest), self.pieces(first) if first else 0)
        except _Irregular:
            return self.pieces(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids and repeated rows each
    give a row, texts of any length are counted whole; other columns are ignored, whatever their
    names; an empty table gives an empty result. ``vocabulary`` is the path of a byte-level BPE file that every executor can open (byte_bpe_50k.json of the
    public tokenizers by default); each worker reads it once, and refuses a file with other
    settings than it counts by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        if path not in _counters:
            _counters[path] = Counter(path)
        count = _counters[path].count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
