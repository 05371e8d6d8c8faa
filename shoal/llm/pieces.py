"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by the longest prefixes of the model's compiled character map, and every byte of
the result remembers the byte it came from. Pairs of pieces are merged by their scores; a piece's span
in the normalised text is projected back to bytes of the original. Two neighbouring characters that no
piece has next to each other can never be merged across, so texts are cut there and equal cuts are
merged once per task.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.words import slices

CACHE_RUNS = 250_000  #: runs a generation of a worker's cache holds; there are two
CACHE_CHARS = 64  #: longer runs are merged anew each time
SHORT = 48  #: up to here a list of pairs is searched, beyond a heap
NEVER = float("inf")
CHUNK = 1 << 20
# fixed values of the model format: kinds of pieces, the sign for a space
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
SPACE = "▁"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else _number(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double array of prefixes and the strings that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.strings = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, bytes replaced) of the longest known prefix of ``data[at:]``; one character stands for itself."""
        units, node, found, size = self.units, 0, -1, 0
        if units:
            node = _offset(units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                unit = units[node] if node < len(units) else 0x80000000
                if unit & 0x800000FF != data[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    found, size = units[node] & 0x7FFFFFFF, i + 1 - at
        if found < 0:
            first = data[at]
            size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            return data[at:at + size], size
        return self.strings[found:self.strings.index(b"\0", found)], size


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


class Model:
    """A BPE model file with its normalisation. Models of another kind, or with pieces of the user's own, are refused."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.byte_fallback = bool(trainer.get(35, 0))
        if trainer.get(3, 1) != BPE_MODEL or {USER_DEFINED, UNUSED} & set(self.kinds) or trainer.get(24, 0) or not self.byte_fallback:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are supported")
        self.set_rules(normalizer)

    def set_rules(self, normalizer: dict) -> None:
        self.map = CharMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(n, 1)) for n in (3, 4, 5))

    @cached_property
    def known(self) -> dict[str, tuple[float, int]]:
        """Piece -> (what the heap sorts by, id)."""
        return {p: (-s, i) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k == NORMAL}

    @cached_property
    def special(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == CONTROL}

    @cached_property
    def byte_ids(self) -> list[int]:
        return [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of every character, whether some piece holds two characters side by side); 0: in no piece of two or more."""
        pairs = {(a, b) for p in self.known for a, b in zip(p, p[1:])}
        letters = sorted({c for pair in pairs for c in pair})
        number = np.zeros(0x110000, np.uint16)
        number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        table = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            table[number[ord(a)], number[ord(b)]] = True
        return number, table

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, the original byte of each of its bytes and of its end)."""
        data, space = text.encode(), (SPACE if self.escape else " ").encode()
        at, n, out, origin = 0, len(data), [], []
        if self.squeeze:
            while at < n:
                new, size = self.map.longest(data, at)
                if new != b" ":
                    break
                at += size
        if at == n:
            return "", np.array([at], np.int64)
        if self.prefix:
            out.append(space)
            origin += [at] * len(space)
        blank = self.squeeze
        while at < n:
            new, size = self.map.longest(data, at)
            if blank:
                new = new.lstrip(b" ")
            if new:
                blank = self.squeeze and new.endswith(b" ")
                same = new == data[at:at + size]
                new = new.replace(b" ", space)
                out.append(new)
                origin += range(at, at + size) if same and len(new) == size else [at] * len(new)
            at += size
        made = b"".join(out)
        while self.squeeze and made.endswith(space):
            made = made[:-len(space)]
            at = origin[len(made)]
        return made.decode(), np.array(origin[:len(made)] + [at], np.int64)


def merge(run: str, known: dict[str, tuple[float, int]]) -> list[str]:
    """Merge the neighbours whose union has the best score, the leftmost of equals, until no union is a piece."""
    if len(run) > SHORT:
        return _merge_long(run, known)
    parts = list(run)
    scores = [known[p][0] if (p := a + b) in known else NEVER for a, b in zip(parts, parts[1:])]
    while scores and (best := min(scores)) < NEVER:
        i = scores.index(best)
        parts[i] += parts[i + 1]
        del parts[i + 1], scores[i]
        if i < len(scores):
            scores[i] = known[p][0] if (p := parts[i] + parts[i + 1]) in known else NEVER
        if i:
            scores[i - 1] = known[p][0] if (p := parts[i - 1] + parts[i]) in known else NEVER
    return parts


def _merge_long(run: str, known: dict[str, tuple[float, int]]) -> list[str]:
    """The same with a heap of pairs."""
    n = len(run)
    end = list(range(1, n + 1))  # of the piece that starts here; 0: none does
    start = list(range(n))  # of the piece that ends before the next place
    heap = [(known[run[i:i + 2]][0], i, i + 2) for i in range(n - 1) if run[i:i + 2] in known]
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        middle = end[a]
        if not middle or middle >= b or end[middle] != b:
            continue
        end[a], end[middle], start[b - 1] = b, 0, a
        if b < n and run[a:end[b]] in known:
            heapq.heappush(heap, (known[run[a:end[b]]][0], a, end[b]))
        if a > 0:
            before = start[a - 1]
            if run[before:b] in known:
                heapq.heappush(heap, (known[run[before:b]][0], before, b))
    out, at = [], 0
    while at < n:
        out.append(run[at:end[at]])
        at = end[at]
    return out


class PieceEncoder:
    def __init__(self, model: Model):
        self.model = model
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        held = [p.encode() for p in model.pieces]
        self.sizes = np.array([1 if k == BYTE else 0 if k == CONTROL else len(p) for p, k in zip(held, model.kinds)], np.int64)
        self.plain = self.sizes - np.array([2 * p.count(SPACE) if k == NORMAL else 0 for p, k in zip(model.pieces, model.kinds)], np.int64)

    def cut(self, text: str) -> list[str]:
        """The text between places that no piece reaches across."""
        number, table = self.model.neighbours
        places = [np.zeros(1, np.int64)]
        for at in range(0, len(text), CHUNK):
            codes = number[np.frombuffer(text[at:at + CHUNK + 1].encode("utf-32-le", "surrogatepass"), "<u4")]
            places.append(np.flatnonzero(~table[codes[:-1], codes[1:]]) + (at + 1))
        borders = np.concatenate(places).tolist()
        return [text[a:b] for a, b in zip(borders, borders[1:] + [len(text)])] if text else []

    def ids_of(self, run: str) -> bytes:
        known, out = self.model.known, []
        for piece in merge(run, known):
            if piece in known:
                out.append(known[piece][1])
            else:
                out += [self.model.byte_ids[b] for b in piece.encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def ids(self, normalised: str) -> np.ndarray:
        if len(self.runs) > CACHE_RUNS:
            self.older, self.runs = self.runs, {}
        runs, older, out = self.runs, self.older, []
        for run in self.cut(normalised):
            got = runs.get(run)
            if got is None:
                got = older.get(run) or self.ids_of(run)
                if len(run) <= CACHE_CHARS:
                    runs[run] = got
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4")

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first original byte, byte after the last) of every piece; the sign put before the text takes no byte."""
        model = self.model
        if not model.map and not model.squeeze and model.escape and SPACE not in text:
            # without a map every character is itself, and a space one sign: spans follow from the pieces alone
            ids = self.ids((SPACE if model.prefix and text else "") + text.replace(" ", SPACE))
            ends = np.cumsum(self.plain[ids])
            lead = int(bool(model.prefix and text))
            return ids, np.maximum(ends - self.plain[ids] - lead, 0), ends - lead
        normalised, origin = model.normalise(text)
        ids = self.ids(normalised)
        ends = np.cumsum(self.sizes[ids])
        return ids, origin[ends - self.sizes[ids]], origin[ends]


class PieceDecoder:
    def __init__(self, model: Model):
        kinds = model.kinds
        texts = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
                 for p, k in zip(model.pieces, kinds)]
        self.control = np.array([k == CONTROL for k in kinds])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(model.pieces, kinds)]) & model.prefix
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        """The text of the ids; the sign before the first piece is left out, bytes that are not UTF-8 become U+FFFD one by one
        (bytes on two sides of ``<s>`` or ``</s>`` make no character together), ids outside the model are skipped."""
        ids = ids[ids < len(self.sizes)].astype(np.int64)
        control = self.control[ids]
        breaks = np.flatnonzero(control[1:] & ~control[:-1]) + 1
        ids, parts = ids[~control], np.diff(np.concatenate(([0], np.cumsum(~control)[breaks - 1], [len(ids) - control.sum()])))
        sizes, firsts = self.sizes[ids], self.firsts[ids]
        if len(ids) and self.spaced[ids[0]]:
            sizes[0] -= 1
            firsts[0] += 1
        out, at = [], 0
        for n in parts.tolist():
            out.append(self._text(sizes[at:at + n], firsts[at:at + n]))
            at += n
        return "".join(out)

    def _text(self, sizes: np.ndarray, firsts: np.ndarray) -> str:
        out = []
        for at in range(0, len(sizes), CHUNK):
            some, first = sizes[at:at + CHUNK], firsts[at:at + CHUNK]
            ends = np.cumsum(some)
            out.append(self.data[np.repeat(first - ends + some, some) + np.arange(ends[-1])].tobytes())
        data = b"".join(out)
        try:
            return data.decode()
        except UnicodeDecodeError:
            return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in data.decode("utf-8", "surrogateescape"))


#: The coder of this Python worker, kept from task to task: (digest of the model, encoder, decoder).
_KEPT: list[tuple[bytes, PieceEncoder, PieceDecoder]] = []


def _coders(data: bytes) -> tuple[PieceEncoder, PieceDecoder]:
    digest = hashlib.sha256(data).digest()
    if not _KEPT or _KEPT[0][0] != digest:
        model = Model(data)
        _KEPT[:] = [(digest, PieceEncoder(model), PieceDecoder(model))]
    return _KEPT[0][1:]


def load_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_pieces: bool = True,
                  ends: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, and ids, begins, stops if asked for).

    ``ids`` are those of the whole text, with ``<s>`` and ``</s>`` if ``ends``; piece i stands for the bytes ``begins[i]`` to
    ``stops[i]`` of the text in UTF-8 (a piece of a byte: for that byte; ends of the text: for none). Digests: ids as
    little-endian 32-bit integers, the decoded text, begin and end of every piece as little-endian 64-bit integers. A null
    text is encoded like an empty one; null and repeated ids pass through, other columns are not read. The model file is
    read on the driver and sent to the tasks: half a megabyte for 32,000 pieces.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def task(batches):
        encoder, decoder = _coders(shipped.value)
        special = encoder.model.special
        first, last = ([special["<s>"]], [special["</s>"]]) if ends else ([], [])
        for part in slices(batches, "text"):
            rows = []
            for text in part.column("text"):
                text = text.as_py() or ""
                ids, begins, stops = encoder(text)
                total = len(text.encode())
                ids = np.concatenate((np.array(first, "<u4"), ids, np.array(last, "<u4")))
                begins = np.concatenate(([0] * len(first), begins, [total] * len(last))).astype("<i8")
                stops = np.concatenate(([0] * len(first), stops, [total] * len(last))).astype("<i8")
                row = [len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoder(ids).encode()).hexdigest(),
                       hashlib.sha256(np.stack((begins, stops), 1).tobytes()).hexdigest()]
                rows.append(row + [ids.astype(np.int32), begins, stops] * with_pieces)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array([r[j] for r in rows], types[j]) for j in range(7 if with_pieces else 4)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] + ["ids", "begins", "stops"] * with_pieces
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    schema += ", ids array<int>, begins array<long>, stops array<long>" * with_pieces
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, schema)


def decode_pieces(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of ids; null ids give an empty text, ids outside the model are skipped."""
    shipped = tokens.sparkSession.sparkContext.broadcast(load_model(model_path))

    def task(batches):
        decoder = _coders(shipped.value)[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decoder(np.array([i for i in ids.as_py() or () if i is not None and i >= 0], np.int64)) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(task, "doc_id long, text string")
