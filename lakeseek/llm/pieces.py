"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map; every normalised byte remembers the source
byte it came from. The normalised text is cut where no piece of the vocabulary can reach across, each segment is segmented by the
library once and remembered, and every piece is projected back to the span of source bytes that it covers.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm.common import scoped, worker_state

SPACE = "▁"
_SEGMENT = re.compile(" *[^ ]+| +")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[^A-Za-zÀ-ÖØ-öø-ɏ]+")
_INTS = T.ArrayType(T.IntegerType())


class CharsMap:
    """A compiled character map: a double array over source bytes and the strings its values point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest prefix of data[at:] in the map."""
        if not self.units:
            return None
        units, found = self.units, None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)  # noqa: E731  a unit's offset
        node = step(units[0])
        for i in range(at, len(data)):
            c = data[i]
            if c == 0:
                break
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if (unit & 0x800000FF) != c:
                break
            node ^= step(unit)
            if unit & 256:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found


def _segments(text: str) -> list[str]:
    """Runs of spaces with what follows, each less one space: the mark that the encoder adds in front makes that up."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [s[1:] for s in _SEGMENT.findall(" " + text)]
    return text.split(" ")


class Encoder:
    """encode() gives ids and source spans, decode() a text; both as the library does."""

    def __init__(self, model: bytes, most: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        self.map, self.dummy, self.strip, self.escape = CharsMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        suffix = proto.trainer_spec.treat_whitespace_as_suffix
        normal = [p.piece for p in proto.pieces if p.type in (1, 4, 5)]
        self.end = next((i for i, p in enumerate(proto.pieces) if p.piece == (proto.trainer_spec.eos_piece or "</s>")), -1)
        # A segment is a run of space marks and what follows, if no piece holds a mark after another character.
        self.apart = self.escape and not suffix and proto.trainer_spec.model_type == 2 and not any(SPACE in p.lstrip(SPACE) for p in normal)
        # Within a segment, parts end where Latin letters meet other characters, if no piece mixes them, and at line breaks, which no piece holds.
        self.letters = self.apart and not any("\n" in p for p in normal) and not any(len(_LETTERS.findall(p.replace(SPACE, ""))) > 1 for p in normal)
        self.plain = self.apart and self.dummy and not self.strip and not self.map.units
        kinds = [p.type for p in proto.pieces]
        self.out = [bytes([int(p.piece[3:5], 16)]) if k == 6 else b"" if k == 3 else (proto.trainer_spec.unk_surface.encode() if k == 2 else p.piece.replace(SPACE, " ").encode()) for p, k in zip(proto.pieces, kinds, strict=True)]
        self.normal_bytes = np.array([1 if k == 6 else len(p.piece.encode()) for p, k in zip(proto.pieces, kinds, strict=True)], np.int32)
        self.source_bytes = np.array([len(b) for b in self.out], np.int32)
        self.names = [str(i) for i in range(len(kinds))]
        self.words: dict[str, tuple[bytes, str, bytes]] = {}
        self.heads, self.tails = {}, {}
        self.most = most

    def _learn(self, words: list[str]) -> None:
        """Remembers segments, each without its first space mark."""
        if len(self.words) + len(words) > self.most:
            self.words.clear()
        split = [self._parts(w) for w in words]
        for held, lead, need in ((self.heads, "", {p[0] for p in split}), (self.tails, "\n", {r for p in split for r in p[1:]})):
            new = list(need.difference(held))
            if len(held) + len(new) > self.most:
                held.clear()
                new = list(need)
            # Behind a line break, whose own pieces come off again, a part has no space mark.
            off = len(self.sp.encode(lead)) if lead else 0
            for x, ids in zip(new, self.sp.encode([lead + n for n in new], num_threads=1), strict=True):
                held[x] = self._entry(ids[off:] if x else [self.sp.piece_to_id(SPACE)])
        heads, tails, known = self.heads, self.tails, self.words
        for w, p in zip(words, split, strict=True):
            if len(p) == 1:
                known[w] = heads[w]
            elif len(p) == 2:
                (a, b, c), (d, e, f) = heads[p[0]], tails[p[1]]
                known[w] = a + d, f"{b} {e}", c + f
            else:
                x = [heads[p[0]], *(tails[r] for r in p[1:])]
                known[w] = b"".join([i[0] for i in x]), " ".join([i[1] for i in x]), b"".join([i[2] for i in x])

    def _parts(self, word: str) -> list[str]:
        """Parts of a segment that no piece reaches across: letters and what isn't."""
        if not self.letters or not word:
            return [word]
        cut = _LETTERS.findall(word)
        if len(cut) > 1 and not cut[0].strip(" "):
            cut[:2] = [cut[0] + cut[1]]  # space marks go with what follows them
        return cut

    def _entry(self, ids: list[int]) -> tuple[bytes, str, bytes]:
        names, out = self.names, self.out
        return array("i", ids).tobytes(), " ".join([names[i] for i in ids]), b"".join([out[i] for i in ids])

    def batch(self, texts: list[str]):
        """Yields (ids bytes, ids text, decoded text, begins, ends) of each text; the last three cost nothing until called."""
        if not self.plain:
            for t in texts:
                ids, begins, ends = self._general(t)
                yield ids.tobytes(), " ".join(map(str, ids.tolist())), self.sp.decode(ids.tolist()), begins, ends
            return
        split = [_segments(t) for t in texts]
        words = self.words
        for i, (text, parts) in enumerate(zip(texts, split, strict=True)):
            if SPACE in text or "\0" in text:
                ids, begins, ends = self._general(text)
                yield ids.tobytes(), " ".join(map(str, ids.tolist())), self.sp.decode(ids.tolist()), begins, ends
                continue
            try:
                held = [words[w] for w in parts]
            except KeyError:
                ahead = {w for p in split[i : i + 256] for w in p}
                self._learn([w for w in ahead if w not in words])
                if any(w not in words for w in parts):
                    self._learn([w for w in set(parts) if w not in words])
                held = [words[w] for w in parts]
            ids = b"".join([h[0] for h in held])
            ends = np.cumsum(self.source_bytes[np.frombuffer(ids, np.int32)]) - 1 if ids else np.empty(0, np.int64)
            begins = np.concatenate(([0], ends[:-1])) if ids else ends
            decoded = b"".join([h[2] for h in held])[1:].decode("utf-8", "replace")
            yield ids, " ".join([h[1] for h in held]), decoded, begins, ends

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the source byte where it comes from; one more entry for the end."""
        data, out, source, at = text.encode(), bytearray(), [], 0
        mark = SPACE.encode() if self.escape else b" "

        def add(piece: bytes, origin: int) -> None:
            out.extend(piece)
            source.extend([origin] * len(piece))

        chunks = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, data[at : at + n]
            chunks.append((at, hit[1]))
            at += hit[0]
        if self.strip:
            while chunks and not chunks[0][1].strip(b" "):
                chunks.pop(0)
        if chunks and self.dummy:
            add(mark, chunks[0][0])
        spaced = self.strip
        for origin, piece in chunks:
            if self.strip and spaced:
                piece = piece.lstrip(b" ")
            if piece:
                for c in (piece[i : i + 1] for i in range(len(piece))):
                    add(mark if c == b" " else c, origin)
                spaced = self.strip and piece.endswith(b" ")
        end = at
        if self.strip:
            while out.endswith(mark):
                end = source[-1]
                del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, end], np.int64)

    def _general(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Any text and any model: the library's pieces of the text, laid along the normalised bytes."""
        ids = np.array(self.sp.encode(text), np.int32)
        normal, source = self.normalise(text)
        widths = self.normal_bytes[ids]
        unknown = ids == self.sp.unk_id()
        if unknown.any():
            pieces = self.sp.encode(text, out_type=str)
            widths = np.where(unknown, [len(p.encode()) for p in pieces], widths)
        ends = np.cumsum(widths)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces don't cover the normalised text")
        return ids, source[ends - widths], source[ends]


def _encoder(path: str, model: bytes) -> Encoder:
    return worker_state(f"pieces:{path}", "encoder", lambda: Encoder(model))


def _runner(model: bytes, path: str, end: bool, digests: bool, text: str = ""):
    """Rows (key, text), or (row) of which the text is a field."""

    def run(batches):
        encoder = _encoder(path, model)
        tail = [encoder.end] if end else []
        for batch in batches:
            whole = batch.column(1) if batch.num_columns > 1 else batch.column(0).field(text)
            for at in range(0, batch.num_rows, 256):
                texts = [t.as_py() or "" for t in whole.slice(at, 256)]
                keys = batch.column(0).slice(at, 256)
                rows = encoder.batch(texts)
                if digests:
                    n, a, b = [], [], []
                    for t, (ids, written, decoded, _, ends) in zip(texts, rows, strict=True):
                        if len(ends) and (ends[-1] != len(t.encode()) and encoder.plain):
                            raise ValueError("spans don't cover the text")
                        n.append(len(ids) // 4 + len(tail))
                        a.append(hashlib.sha256(" ".join([written, *map(str, tail)] if written else map(str, tail)).encode()).hexdigest())
                        b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids, begins, ends, decoded = [], [], [], []
                    for t, (i, _, d, b, e) in zip(texts, rows, strict=True):
                        n = len(t.encode())
                        ids.append(np.concatenate((np.frombuffer(i, np.int32), np.array(tail, np.int32))))
                        begins.append(np.concatenate((b, [n] * len(tail))).astype(np.int32))
                        ends.append(np.concatenate((e, [n] * len(tail))).astype(np.int32))
                        decoded.append(d)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.list_(pa.int32())) for x in (ids, begins, ends)), pa.array(decoded, pa.string())], names=["_row", "ids", "begins", "ends", "decoded"])

    return scoped(run, f"pieces:{path}")


def encode_pieces(docs: DataFrame, model_path: str, end: bool = True, text: str = "text") -> DataFrame:
    """The documents' columns and ids, begins, ends (array<int>) and decoded (the library's decode of the ids).

    begins and ends are the source bytes each piece covers; an end id covers none, at the text's end. A null or empty text has the end
    id only and decodes to ''. Columns of these names are replaced. Rows stay apart whatever they repeat.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    names = [c for c in docs.columns if c not in ("ids", "begins", "ends", "decoded")]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), *([] if docs.schema[text].dataType == T.StringType() and text in names else [F.col(f"`{text}`").cast("string").alias("_text")]))
    schema = row.select("_row").schema.add("ids", _INTS).add("begins", _INTS).add("ends", _INTS).add("decoded", "string")
    return row.mapInArrow(_runner(model, model_path, end, False, text), schema).select("_row.*", "ids", "begins", "ends", "decoded")


def piece_digests(docs: DataFrame, model_path: str, end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, of the same encoding as encode_pieces."""
    with open(model_path, "rb") as f:
        model = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_runner(model, model_path, end, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the library's decode of an array of ids (null for a null array)."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        encoder = _encoder(model_path, model)
        for batch in batches:
            texts = [encoder.sp.decode(x.as_py()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", out])

    names = [c for c in rows.columns if c != out]
    row = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{ids}`").alias("_ids"))
    return row.mapInArrow(scoped(run, f"pieces:{model_path}"), row.select("_row").schema.add(out, "string")).select("_row.*", out)
