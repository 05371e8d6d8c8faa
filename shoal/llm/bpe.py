"""Byte-level BPE by a pair occurrence index.

A task cuts its texts into pieces and encodes the distinct ones together. An index maps each pair
of neighbouring symbols to all its places in these pieces; a heap holds the ranks that are active.
Ranks are applied in ascending order, each to all places of its pair at once, and the lists of the
pairs next to a merge are updated. Merges in different pieces never touch, and inside a piece the
lowest rank goes first, from left to right, so the result is that of piece-by-piece encoding.

The vocabulary file's place is a parameter; the driver reads it and ships it to the tasks.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.words import slices

#: Fixed value: the pattern that cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 3 << 20
CACHE_RUNS = 200_000
CHUNK = 1 << 18
SHIFT, LOW = 24, (1 << 24) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Ids of single bytes, ranks of pairs of ids, bytes of each id, and special strings, from a tokenizer JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    letters = byte_letters()
    back = {c: b for b, c in enumerate(letters)}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[left] << SHIFT | ids[right]] = (rank, ids[left + right])
    pieces = {i: bytes(back[c] for c in t) for t, i in ids.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces |= {i: t.encode() for t, i in special.items()}
    keys = np.array(sorted(merges), np.int64)
    return {"bytes": [ids[c] for c in letters], "merges": merges, "sorted": keys, "pieces": pieces, "special": special}


def merge_all(pieces: list[bytes], vocabulary: dict) -> list[bytes]:
    """Ids of each piece as little-endian 32-bit integers, all pieces merged together through the pair occurrence index."""
    merges = vocabulary["merges"]
    pair_keys = vocabulary["sorted"]
    # One row of symbols for all pieces, a border (-1) before each and at the end; links skip dead places (-2).
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    symbols = np.full(len(data) + len(pieces) + 1, -1, np.int32)
    symbols[np.arange(len(data)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)] = np.array(vocabulary["bytes"], np.int32)[data]
    n = len(symbols)
    left, right = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    index: dict[int, list[np.ndarray]] = {}
    active: list[tuple[int, int]] = []

    def enter(first: np.ndarray, second: np.ndarray, places: np.ndarray) -> None:
        keys = np.where((first >= 0) & (second >= 0), (first.astype(np.int64) << SHIFT) | second, -1)
        known = pair_keys[np.minimum(np.searchsorted(pair_keys, keys), len(pair_keys) - 1)] == keys
        keys, places = keys[known], places[known]
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for key, found in zip(keys[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places]):
            if key in index:
                index[key].append(found)
            else:
                index[key] = [found]
                heapq.heappush(active, (merges[key][0], key))

    for at in range(0, n - 1 if len(pair_keys) else 0, CHUNK):
        end = min(at + CHUNK, n - 1)
        enter(symbols[at:end], symbols[at + 1:end + 1], np.arange(at, end, dtype=np.int32))
    while active:
        pair = heapq.heappop(active)[1]
        found = index.pop(pair)
        a, b, made = pair >> SHIFT, pair & LOW, merges[pair][1]
        places = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        places = places[symbols[places] == a]
        places = places[symbols[right[places]] == b]
        if a == b:  # of places that overlap, the left one goes first
            chosen, taken = [], -1
            for at, after in zip(places.tolist(), right[places].tolist()):
                if at != taken:
                    chosen.append(at)
                    taken = after
            places = np.array(chosen, np.int32)
        if not len(places):
            continue
        dead = right[places]
        symbols[places], symbols[dead] = made, -2
        after = right[dead]
        right[places], left[after] = after, places
        before = left[places]
        enter(np.concatenate((symbols[before], symbols[places])), np.concatenate((symbols[places], symbols[after])),
              np.concatenate((before, places)))
    alive = np.flatnonzero(symbols >= 0)
    raw, cuts = symbols[alive].astype("<u4").tobytes(), 4 * np.searchsorted(alive, np.append(starts, n))
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Encoder:
    """Encodes texts slice by slice; runs of text seen lately are kept with their ids."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self.cut = regex.compile(PIECES).findall
        spaces = "".join(regex.findall(r"\s", "".join(map(chr, range(0x3100)))))
        #: A run is what lies between white space, with one space before it: it begins and ends with a piece.
        self.runs = re.compile(f" ?[^{spaces}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
        special = vocabulary["special"]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def cut_text(self, text: str) -> list[str]:
        special = self.vocabulary["special"]
        if not any(s in text for s in special):
            return self.runs(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in special else self.runs(part)
        return out

    def learn(self, runs: list[str]) -> None:
        """Enter the ids of new runs; white space between pieces of one run cannot occur, so a line feed parts runs."""
        special, known = self.vocabulary["special"], self.known
        whole = [r for r in runs if r not in special and r.isspace()]
        mixed = [r for r in runs if r not in special and not r.isspace()]
        pieces = self.cut("\n".join(mixed))
        distinct = list(dict.fromkeys(pieces + whole))
        ids = dict(zip(distinct, merge_all([p.encode() for p in distinct], self.vocabulary)))
        known.update((r, ids[r]) for r in whole)
        known.update((s, np.array([i], "<u4").tobytes()) for s, i in special.items())
        parts, sizes, at = [ids[p] for p in pieces], np.cumsum([p == "\n" for p in pieces]), 0
        borders = np.flatnonzero(np.diff(sizes, prepend=0)).tolist() + [len(pieces)]
        for run, end in zip(mixed, borders):
            known[run] = parts[at] if end == at + 1 else b"".join(parts[at:end])
            at = end + 1

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        gc.disable()  # nothing here is cyclic, and millions of strings are slow to search for cycles
        cut = [self.cut_text(t) for t in texts]
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
        known = self.known
        fresh = set().union(*cut) - known.keys()
        if fresh:
            self.learn(list(fresh))
        gc.enable()
        return [np.frombuffer(b"".join([known[r] for r in x]), "<u4") for x in cut]


class Decoder:
    """Bytes of ids, gathered from one table of all pieces."""

    def __init__(self, vocabulary: dict):
        pieces = vocabulary["pieces"]
        table = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]
        self.sizes = np.array([len(p) for p in table], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        """Byte sequences that are not UTF-8 become U+FFFD; ids outside the vocabulary are skipped."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at:at + (1 << 18)].astype(np.int64)
            part = part[(part >= 0) & (part < len(self.sizes))]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            places = np.repeat(self.firsts[part] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            out.append(self.data[places].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids if asked for).

    ``ids`` is an array of the token ids of the whole text, special strings as their ids, nothing added;
    the digests are of the ids as little-endian 32-bit integers and of the text decoded from them. A null
    text is encoded like an empty one; null and repeated ids pass through, other columns are not read.
    """
    vocabulary = load_vocabulary(vocabulary_path)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file, about 50,000 entries

    def task(batches):
        encoder, decoder = Encoder(shipped.value), Decoder(shipped.value)
        for part in slices(batches, "text", SLICE_BYTES):
            ids = encoder([t or "" for t in part.column("text").to_pylist()])
            columns = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                       pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                       pa.array([hashlib.sha256(decoder(x).encode()).hexdigest() for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, schema)


def decode(tokens: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of token ids; null ids give an empty text, ids outside the vocabulary are skipped."""
    shipped = tokens.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def task(batches):
        decoder = Decoder(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(
                    [decoder(np.array([i for i in x or () if i is not None and i >= 0], np.int64)) for x in part.column("ids").to_pylist()], pa.string())],
                    ["doc_id", "text"])
    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(task, "doc_id long, text string")
