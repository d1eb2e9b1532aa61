"""Harmonic packing of token sequences.

Every worker tokenises its documents, cuts them into pieces and sorts the pieces into reciprocal-capacity classes:
a piece of length n belongs to class k = capacity // n, whose bins hold exactly k pieces. A class's bin is closed when it has its
k pieces, independently of all other classes and workers, so full bins need no shuffle. What a worker's open bins hold
goes on to the next level, where the leftovers of ``fan_in`` workers fill bins by the same rule, and so on until one group is left;
that group's rest is at most one open bin for each class (a constant), which is laid end to end and cut where a bin is full.

Cuts keep padding low: a remainder that would waste more than ``slack`` of its class's share is cut at the largest reciprocal
capacity // k below it, and its own remainder is a further piece.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, durable, kept, task

CAPACITY = 2048
END_ID = 1
#: Words whose ids a worker remembers; beyond that the memory starts anew.
CACHE_WORDS = 400_000


class CachedEncoder:
    """Ids of a text as little-endian bytes. The tokenizer never joins characters across white space, so ids are looked up per word.

    An unknown word of Latin characters is lowered and cut here as the file's normalizer and pre-tokenizer say, and the
    library's BPE model gives the ids of each part; any other word goes through the library's whole tokenizer. A special token's string in a text
    gives that token's id, as the library does by default; with ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], [n["type"] for n in spec["normalizer"]["normalizers"]]) != (_PATTERN, ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"{path}: cuts words in another way than this encoder knows")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.split() != [t] for t in special):
            raise ValueError(f"{path}: has a special token with white space")
        self.special = re.compile("|".join(map(re.escape, special))).search if special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        self.parts: dict[str, bytes] = {"\n": _MARK}
        if max(model["vocab"].values()) >= 1 << 16:
            raise ValueError(f"{path}: identifiers beyond 65535")
        self.cache: dict[str, bytes] = {"": b""}
        self.cache_words = cache_words

    def _ids(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.bpe.tokenize(shown)]).tobytes()

    def _cut(self, words: list[str], find: Callable) -> Iterable[bytes]:
        """The ids of words that ``find`` cuts into parts: all words as one text, in which a line end stands between two words and a mark between their ids."""
        cut, parts = find("\n".join(words).lower()), self.parts
        for p in set(cut).difference(parts):
            parts[p] = self._ids(p)
        return b"".join(map(parts.__getitem__, cut)).split(_MARK)

    def _new(self, words: list[str]) -> None:
        """Look up words that aren't known yet."""
        ascii_, latin, rest = [], [], []
        special = self.special if self.special and self.special("\n".join(words)) else None
        for w in words:
            (rest if special and special(w) else ascii_ if w.isascii() else latin if _SIMPLE(w) else rest).append(w)
        if ascii_:
            self.cache.update(zip(ascii_, self._cut(ascii_, _ASCII_PARTS)))
        if latin:
            self.cache.update(zip(latin, self._cut(latin, _LATIN_PARTS)))
        for w in rest:
            self.cache[w] = array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, in order."""
        split = [t.translate(_TO_SPACE).split(" ") if t and any(c in t for c in "\t\x0b\x0c\r") else t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache, self.parts = {"": b""}, {"\n": _MARK}
        get, held, new = self.cache.get, [], set()
        for words in split:
            ids = list(map(get, words))
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else ()
            new.update([words[i] for i in gaps])
            held.append((words, ids, gaps))
        if new:
            self._new(list(new))
        for words, ids, gaps in held:
            for i in gaps:
                ids[i] = get(words[i])
        return [b"".join(ids) for _, ids, _ in held]


#: Between the ids of two words; no id has such bytes, as all are below 2**16.
_MARK = b"\xff\xff\xff\xff"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+").findall
_LATIN_PARTS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
#: Latin characters up to U+024F, each of which is its own NFC form and lowers to one character.
_SIMPLE = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch
#: The byte-level alphabet: printable Latin-1 characters show themselves, the others characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_TO_SPACE = str.maketrans({c: " " for c in WS_CHARS})


def encoder(path: str, special_as_text: bool = False) -> CachedEncoder:
    return kept(("encoder", path, special_as_text), lambda: CachedEncoder(path, special_as_text=special_as_text))


def cut_points(length: int, capacity: int = CAPACITY, slack: float = 0.03) -> list[int]:
    """Lengths of the pieces of a document: whole capacities first, then a remainder that is cut at most twice.

    >>> cut_points(5000), cut_points(1024), cut_points(1100)
    ([2048, 2048, 904], [1024], [1024, 76])
    """
    out = [capacity] * (length // capacity)
    rest, cuts = length % capacity, 0
    while rest:
        share = capacity // (capacity // rest)
        if cuts == 2 or share - rest <= slack * share or rest <= 16:
            out.append(rest)
            break
        piece = capacity // (capacity // rest + 1)
        out.append(piece)
        rest -= piece
        cuts += 1
    return out


class HarmonicFiller:
    """Open bins by class. ``add`` returns the bin that the piece filled, or None."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, length: int, item) -> list | None:
        k = self.capacity // length
        if k == 1:
            return [item]
        bin_ = self.open.setdefault(k, [])
        bin_.append(item)
        if len(bin_) == k:
            del self.open[k]
            return bin_
        return None

    def rest(self) -> list:
        return [item for k in sorted(self.open) for item in self.open[k]]


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long, worker long, item long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("worker", pa.int64()), ("item", pa.int64())])
_KEYS = _ARROW.names
#: Sequence numbers that one worker may give at one level.
_ROOM = 1 << 32


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], type=f.type) for f in _ARROW], schema=_ARROW)


def _fill_worker(path: str, capacity: int, slack: float, with_ids: bool, end_id: int, special_as_text: bool) -> Callable:
    """Leftovers keep their ids, which the last level may have to cut; full bins keep them on request."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, filler, out, number, item = encoder(path, special_as_text), HarmonicFiller(capacity), [], 0, 0
        worker = 0
        for batch in batches:
            ids, texts, workers = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            worker = workers[0].as_py() if len(workers) else 0
            step = 256
            for lo in range(0, len(ids), step):
                for doc, raw in zip(ids[lo : lo + step], enc.encode_batch(texts.slice(lo, step).to_pylist())):
                    raw += end
                    total, start = len(raw) // 4, 0
                    for length in cut_points(total, capacity, slack):
                        part = raw[4 * start : 4 * (start + length)]
                        full = filler.add(length, [doc, start, length, zlib.crc32(part), total, part, None, None, worker, item])
                        item, start = item + 1, start + length
                        if full:
                            at = 0
                            for row in full:
                                row[6:8] = worker * _ROOM + number, at
                                at += row[2]
                                if not with_ids:
                                    row[5] = None  # only leftovers, which may have to be cut, need their ids
                            number += 1
                            out += full
                    if len(out) >= 1024:
                        yield _emit(out)
                        out = []
        yield _emit(out + filler.rest())

    return run


def _fill_group(capacity: int, level: int, last: bool, with_ids: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted((list(r.values()) for r in table.to_pylist()), key=lambda r: (r[8], r[9]))
        filler, out, number = HarmonicFiller(capacity), [], 0
        group = rows[0][8] >> (6 * level) if rows else 0
        base = ((level << 24) + group) * _ROOM

        def close(bin_: list) -> None:
            nonlocal number
            at = 0
            for row in bin_:
                row[6:8] = base + number, at
                at += row[2]
            number += 1
            out.extend(bin_)

        for row in rows:
            if full := filler.add(row[2], row):
                close(full)
        rest = filler.rest()
        if not last:
            out += rest
        else:  # at most one open bin for each class: end to end, cut where a bin is full
            bin_, used = [], 0
            for row in sorted(rest, key=lambda r: (-r[2], r[8], r[9])):
                while row is not None:
                    room = capacity - used
                    head, row = (row, None) if row[2] <= room else _cut(row, room, with_ids)
                    bin_.append(head)
                    used += head[2]
                    if used == capacity:
                        close(bin_)
                        bin_, used = [], 0
            if bin_:
                close(bin_)
        return pa.Table.from_batches([_emit(out)])

    return run


def _cut(row: list, at: int, with_ids: bool) -> tuple[list, list]:
    """A piece in two. Without ids the checksum of a part isn't known, so the ids of leftovers are always carried."""
    ids = row[5]
    a, b = list(row), list(row)
    a[2], b[2] = at, row[2] - at
    a[5], b[5] = ids[: 4 * at], ids[4 * at :]
    a[3], b[3] = zlib.crc32(a[5]), zlib.crc32(b[5])
    b[1] = row[1] + at
    return a, b


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: float = 0.03, fan_in: int = 64, with_ids: bool = True, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Null texts are empty; every document ends with ``end_id``, so an empty one is a piece of one id. Null identifiers stay null. Repeated rows
    are packed as often as they occur. Texts of any length are cut. Other columns are ignored. An empty table gives an empty result.
    ``with_ids=False`` leaves the ids of full bins out (the column is null). A special token's string in a text gives that token's id, as in the library's
    default; with ``special_as_text`` it is tokenised like any other text.
    """
    if fan_in != 64:
        raise ValueError("groups are of 64 workers at each level")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("worker"))
    first = durable(rows.mapInArrow(task(_fill_worker(tokenizer_path, capacity, slack, with_ids, end_id, special_as_text)), PIECE_SCHEMA))
    done = [first.filter("sequence_id is not null")]
    rest = first.filter("sequence_id is null")
    workers, level = (first.agg(F.max("worker")).first()[0] or 0) + 1, 1
    while True:
        groups = -(-workers // 64)
        grouped = rest.withColumn("g", F.shiftright("worker", 6 * level)).groupBy("g").applyInArrow(_dropping_key(_fill_group(capacity, level, groups == 1, with_ids)), PIECE_SCHEMA)
        if groups == 1:
            done.append(grouped)
            break
        grouped = durable(grouped)
        done.append(grouped.filter("sequence_id is not null"))
        rest, workers, level = grouped.filter("sequence_id is null"), groups, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("worker", "item")


def _dropping_key(fill: Callable) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        return fill(table.select(_KEYS))

    return run
