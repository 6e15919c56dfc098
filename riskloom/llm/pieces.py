"""SentencePiece encoding with byte offsets into the original text, and decoding.

Normalising follows the model's compiled character map: at each position the longest prefix that the
map's double array knows is replaced, anything else is copied, and every normalised byte records the
original byte it came from. Pieces are cut from the normalised text, so their boundaries project to
byte spans of the original. Models whose map is empty (identity) and whose pieces hold the space mark
at the front alone are encoded segment by segment (a space mark and what follows it): no merge crosses
such a border, and a segment is encoded once and remembered. All other models, and texts with runs of
spaces, take the library's whole-text path.
"""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A task remembers so many segments, then starts anew.
SEGMENTS = 150_000


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def proto_fields(data: bytes):
    """(number, value) of the top fields of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


class CharMap:
    """Longest-prefix replacement through a compiled character map (a double array and its strings)."""

    def __init__(self, spec: bytes):
        # Fields of the normaliser's description.
        fields = dict(proto_fields(spec))
        blob = fields.get(2, b"")
        self.dummy_prefix = bool(fields.get(3, 1))
        self.squeeze = bool(fields.get(4, 1))
        self.units, self.strings = (), b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = struct.unpack(f"<{size // 4}I", blob[4:4 + size])
            self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest known prefix of text[at:], and its length; length 0 if none."""
        units, best, value = self.units, 0, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != text[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                best, value = i + 1 - at, units[node] & ((1 << 31) - 1)
        if not best:
            return b"", 0
        return self.strings[value:self.strings.index(b"\0", value)], best

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them and the end the original byte it starts from."""
        raw, out, source, at = text.encode(), bytearray(), [], 0
        mark = MARK.encode()
        while at < len(raw):
            new, size = self.longest(raw, at) if self.units else (b"", 0)
            if not size:
                size = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                new = raw[at:at + size]
            # As in the library: a space begins at the source of its replacement.
            for byte in new:
                if byte == 32:
                    if self.squeeze and (not out or out.endswith(mark)):
                        continue
                    out += mark
                    source += [at] * 3
                else:
                    out.append(byte)
                    source.append(at)
            at += size
        end = len(raw)
        while self.squeeze and out.endswith(mark):
            end = source[-1]
            del out[-3:], source[-3:]
        if out and self.dummy_prefix:
            out[:0], source[:0] = mark, [source[0]] * 3
        return bytes(out), [*source, end]


class Encoder:
    """Ids and original byte spans of whole texts, as the library encodes them."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        fields = [v for k, v in proto_fields(model) if k == 3]
        self.chars = CharMap(fields[-1] if fields else b"")
        count = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(count)]
        self.lengths = np.array([1 if self.library.is_byte(i) else len(p.encode())
                                 for i, p in enumerate(pieces)])
        self.unknown = self.library.unk_id()
        # Without byte pieces an unknown character has no fixed length.
        self.by_segment = (
            not self.chars.units and self.chars.dummy_prefix and not self.chars.squeeze
            and any(self.library.is_byte(i) for i in range(count))
            and not any(MARK in p.lstrip(MARK) for p in pieces)
            and self.library.piece_to_id(MARK) != self.unknown
        )
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.text_of = [str(i) for i in range(count)]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if not self.by_segment or not text or MARK in text or "  " in text or " " in (text[0], text[-1]):
            return np.array(self.library.encode(text), np.int32)
        segments, known = text.split(" "), self.known
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            if len(known) > SEGMENTS:
                known.clear()
                new = list(dict.fromkeys(segments))
            # Unknown segments are encoded in one go and cut where a piece holds the next space mark.
            ids = np.array(self.library.encode(" ".join(new)), np.int32)
            cuts = [*np.flatnonzero(self.marked[ids]).tolist(), len(ids)]
            if len(cuts) != len(new) + 1:
                raise ValueError("a piece crosses a segment's border")
            known.update(zip(new, (ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:]))))
        return np.frombuffer(b"".join([known[s] for s in segments]), np.int32)

    def said(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by commas."""
        text_of = self.text_of
        return ",".join([text_of[i] for i in ids.tolist()])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end bytes in the original text of every piece."""
        if self.by_segment:
            raw = np.frombuffer(text.encode(), np.uint8)
            # A space is three normalised bytes, the dummy space in front has no original byte.
            spaces = np.flatnonzero(raw == 32)
            starts = 3 + spaces + 2 * np.arange(len(spaces))
            cuts = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            if len(ids) and cuts[-1] != len(raw) + 2 * len(spaces) + 3:
                raise ValueError("pieces and normalised text differ in length")
            cuts = np.maximum(cuts - 3 - 2 * np.searchsorted(starts, cuts), 0)
            return cuts[:-1], cuts[1:]
        normal, source = self.chars.normalise(text)
        cuts, at = [0], 0
        for piece, i in zip(self.library.encode(text, out_type=str), ids.tolist()):
            at += 1 if self.library.is_byte(i) else len(piece.encode())
            cuts.append(at)
        if cuts[-1] != len(normal):
            raise ValueError("pieces and normalised text differ in length")
        source = np.array(source)
        return source[cuts[:-1]], source[cuts[1:]]

    def decode(self, ids) -> str:
        return self.library.decode(ids)


def encode(docs: DataFrame, model: bytes, text: str = "text", into: str = "pieces") -> DataFrame:
    """Add array<struct<id, begin, end>>: the pieces of each text with their original byte spans.

    NULL and empty texts have no pieces. The spans of a text are in order and, with the dummy space
    in front as an empty one, cover all bytes that normalising keeps. One pass, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<id:int,begin:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(held.value)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
        for column in batches:
            rows = []
            for t in column.to_pylist():
                ids = encoder.encode(t or "")
                begins, ends = encoder.spans(t or "", ids)
                rows.append([{"id": i, "begin": b, "end": e}
                             for i, b, e in zip(ids.tolist(), begins.tolist(), ends.tolist())])
            yield pa.array(rows, kind)

    return docs.withColumn(into, run(F.col(text)))


def decode(docs: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of id arrays; NULL or no ids give an empty text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(held.value)
        for column in batches:
            yield pa.array([encoder.decode(x or []) for x in column.to_pylist()], pa.string())

    return docs.withColumn(into, run(F.col(ids)))


def round_trip(docs: DataFrame, model: bytes, text: str = "text", into: str = "tokens") -> DataFrame:
    """Add a struct: number of tokens, digests of ids and of the decoded text, bytes under spans.

    The ids are those of `encode`, written in decimal and joined by commas; the digests are SHA-256
    in lower-case hex. `covered` is the number of original bytes the spans cover. NULL is empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(held.value)
        for column in batches:
            rows = []
            for value in column:
                t = value.as_py() or ""
                ids = encoder.encode(t)
                said, decoded = encoder.said(ids), encoder.decode(ids.tolist())
                begins, ends = encoder.spans(t, ids)
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(),
                             hashlib.sha256(decoded.encode()).hexdigest(), int((ends - begins).sum())))
            n, a, b, covered = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                 pa.array(covered, pa.int64())],
                ["n_tokens", "ids_sha256", "decoded_sha256", "covered"])

    return docs.withColumn(into, run(F.col(text)))
