"""SentencePiece encoding and decoding that keeps, for every piece, the span of the original bytes it stands for."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import texts

SPACE = "▁"
_SPACE = SPACE.encode()


class CharacterMap:
    """The compiled character map of a model: a double-array trie over source strings and a pool of replacements.

    The blob is a little-endian length, the trie's 32-bit units, then the pool of null-ended strings. An empty blob maps
    each character to itself.
    """

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if len(blob) > 4 else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest mapped prefix at ``at``, if any."""
        units = self.units
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and the end the source offset): a byte's own, or where its mapped prefix began."""
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = min(n, len(data) - at), data[at : at + n]
                source += range(at, at + len(hit[1]))
            else:
                source += [at] * len(hit[1])
            out += hit[1]
            at += hit[0]
        source.append(at)
        return bytes(out), np.array(source, np.int64)


class Codec:
    """Encodes by units: a run of spaces and the characters up to the next one.

    In a BPE model none of whose pieces has a space mark behind another character, no merge crosses from one unit to the
    next, so a unit's pieces are the same in every text and are kept in a bounded cache. Models where that doesn't hold,
    or that drop spaces or map characters, encode text by text.
    """

    CACHE = 250_000

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy = spec.add_dummy_prefix
        names = [p.piece for p in model.pieces]
        self.by_unit = (
            model.trainer_spec.model_type == 2 and self.dummy and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not self.map.units
            and not model.trainer_spec.treat_whitespace_as_suffix and model.trainer_spec.byte_fallback
            and all(p.type != 4 for p in model.pieces) and not any(SPACE in x.lstrip(SPACE) for x in names)
        )
        self.end = self.library.eos_id()
        # Bytes of the normalised text, its spaces as marks, that a piece lies over. Pieces for unknown characters have no
        # length of their own, and dropped spaces leave no trace, so such models have ids but no spans.
        self.lengths = np.array([1 if p.type == 6 else 0 if p.type == 3 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.aligned = model.trainer_spec.byte_fallback and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.text_of = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.begins = [x.startswith(SPACE) for x in names]
        self.cache: dict[bytes, list[int]] = {}

    #: A unit of the text with its dummy prefix, spaces being either mark or blank.
    UNIT = re.compile(b"(?: |\xe2\x96\x81)+(?:[^ \xe2]|\xe2(?!\x96\x81))*")

    def _keep(self, unit: bytes, ids: list[int]) -> list[int]:
        if len(self.cache) >= self.CACHE:  # units learned early are the frequent ones
            for k in list(self.cache)[self.CACHE // 2 :]:
                del self.cache[k]
        self.cache[unit] = ids
        return ids

    def _learn_odd(self, unit: bytes) -> list[int]:
        """A unit with several spaces or spaces alone: the library would put its own mark before it."""
        text = unit.decode("utf-8", "replace")
        return self._keep(unit, self.library.encode(text[1:]) if text.strip(" " + SPACE) else self.library.encode("x" + text)[1:])

    def _learn(self, new: list[bytes]) -> dict[bytes, list[int]]:
        """Encode units in one call; each begins at a piece that begins with a space mark, and only there."""
        got, plain = {}, []
        for u in new:
            if len(u) > 1 and u[0] == 32 and u[1] != 32 and _SPACE not in u:
                plain.append(u)
            else:
                got[u] = self._learn_odd(u)
        for k in range(0, len(plain), 1000):
            some, begins = plain[k : k + 1000], self.begins
            ids = self.library.encode(b"".join(some)[1:].decode("utf-8", "replace"))
            cuts = [i for i, x in enumerate(ids) if begins[x]]
            cuts.append(len(ids))
            if len(cuts) != len(some) + 1:
                raise ValueError("a piece crosses a space")
            for u, a, b in zip(some, cuts, cuts[1:], strict=False):
                got[u] = self._keep(u, ids[a:b])
        return got

    def units(self, data: bytes) -> list[list[int]]:
        """The ids of each unit of the text."""
        if b"\xe2\x96\x81" in data or b"  " in data or data[:1] == b" " or data[-1:] == b" ":
            found = self.UNIT.findall(b" " + data)
        else:
            found = [b" " + w for w in data.split(b" ")]
        cache = self.cache
        got = [cache.get(u) for u in found]
        if None in got:
            learned = self._learn(list({u: None for u, x in zip(found, got, strict=True) if x is None}))
            got = [x or learned[u] for u, x in zip(found, got, strict=True)]
        return got

    def encode(self, data: bytes) -> list[int]:
        """All ids of the whole text and the end id."""
        if not data:
            return [self.end]
        if self.by_unit:
            return [*chain.from_iterable(self.units(data)), self.end]
        return [*self.library.encode(data.decode("utf-8", "replace")), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def spans(self, data: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, starts, ends): for each id the original bytes [start, end) that it came from; the end id spans none.

        The text is normalised by longest prefixes, which records where each byte came from; spaces become marks, one is
        put before the text, and pieces are laid over the result in order. Their edges are read through the record: a
        piece spans what its bytes came from, the mark before the text nothing.
        """
        ids = self.encode(data)
        if not self.aligned:
            raise ValueError("a model that drops spaces or has no pieces for single bytes can't be aligned")
        plain, source = self.map.normalise(data)
        back = np.repeat(source[:-1], np.where(np.frombuffer(plain, np.uint8) == 32, len(_SPACE), 1))
        mark = len(_SPACE) if self.dummy and data else 0
        back = np.concatenate([np.zeros(mark, np.int64), back, source[-1:]])
        edges = np.concatenate([[0], np.cumsum(self.lengths[ids[:-1]])]) if len(ids) > 1 else np.zeros(1, np.int64)
        if edges[-1] != len(back) - 1:
            raise ValueError("the pieces don't cover the normalised text")
        edges = back[edges]
        return ids, np.append(edges[:-1], len(data)), np.append(edges[1:], len(data))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, one for each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__ids``, ``__starts``, ``__ends``: pieces and the bytes of the text they stand for.

    A null text is empty: it has the end id alone, spanning nothing. The model file has to lie at ``model_path`` on
    every executor. Other columns pass through; an empty table stays empty.
    """

    @F.pandas_udf("struct<ids: array<int>, starts: array<bigint>, ends: array<bigint>>")
    def encode(column):
        import pandas as pd

        got = [codec(model_path).spans(b"" if x is None else x.encode("utf-8", "surrogatepass")) for x in column]
        return pd.DataFrame(got, columns=["ids", "starts", "ends"])

    done = docs.withColumn("__encoded", encode(F.col(f"`{text_col}`")))
    return done.withColumns({f"__{k}": F.col(f"__encoded.{k}") for k in ("ids", "starts", "ends")}).drop("__encoded")


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "__ids") -> DataFrame:
    """All columns of ``df`` and ``__decoded``; null ids give null, no ids the empty text."""

    @F.pandas_udf("string")
    def decode(column):
        import pandas as pd

        return pd.Series([None if x is None else codec(model_path).decode([int(i) for i in x]) for x in column], dtype=object)

    return df.withColumn("__decoded", decode(F.col(f"`{ids_col}`")))


def _report(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = codec(path)
    names = {}
    for b in batches:
        rows = []
        for data in texts(b["text"]):
            ids, starts, ends = model.spans(data)
            for i in ids:
                if i not in names:
                    names[i] = str(i)
            told = " ".join([names[i] for i in ids])
            edges = hashlib.sha256(starts.astype("<i8").tobytes() + ends.astype("<i8").tobytes())
            rows.append((len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest(), int((ends - starts).sum()), edges.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned", "spans_sha256"])


def model_file() -> str:
    """Where the 32k byte-fallback BPE model lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_report(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The columns of op10 and of the alignment: bytes that pieces span, and a digest of all their starts and ends.

    Every text is encoded, normalised, aligned and decoded as by ``encode_texts`` and ``decode_ids``; of a null or empty
    text there is the end id alone. Repeated rows give equal rows, null ids stay null, an empty table gives no rows, and
    columns other than doc_id and text are not read.
    """
    path = model_path or model_file()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _report(batches, path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_spanned bigint, spans_sha256 string")
